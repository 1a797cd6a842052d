"""Triples from extraction files in four layouts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fadegraph.functions.text import first_text, strip
from fadegraph.session import broadcast_if_small, cut_lineage
from fadegraph.sources.files import read_files
from fadegraph.sources.json_parts import CHUNK_BYTES, split_json

# The field names of each layout.
_LAYOUT_FIELDS = {
    "stanford": ("subject", "relation", "object"),
    "allennlp": ("arg1", "rel", "arg2"),
    "clausie": ("subject", "predicate", "object"),
}
# For the generic layout the first name that is present counts.
_GENERIC_FIELDS = (("subject", "arg1"), ("relation", "predicate", "rel"), ("object", "arg2"))


def _has_keys(text: Column, *keys: str) -> Column:
    """Whether the text is a JSON object with these keys, whatever their values."""
    present = F.json_object_keys(text)
    found = reduce(lambda a, b: a & b, [F.array_contains(present, k) for k in keys])
    return F.coalesce(found, F.lit(False))


def layout(text: Column) -> Column:
    """Name of the layout of a file's text."""
    first = F.get_json_object(text, "$[0]")
    return (
        F.when(_has_keys(text, "sentences"), "stanford")
        .when(_has_keys(text, "triples") | _has_keys(text, "extractions"), "generic")
        .when(_has_keys(first, "arg1", "rel"), "allennlp")
        .when(_has_keys(first, "subject", "predicate"), "clausie")
        .otherwise("unknown")
    )


def _items(files: DataFrame) -> DataFrame:
    """One row per extraction, as JSON text; a file without a list of them gives one row without a position.

    Every list is read as texts first, so one bad item does not touch the others.
    """
    texts = "array<string>"
    sentences = F.from_json(F.get_json_object("text", "$.sentences"), texts)
    nested = F.flatten(F.transform(sentences, lambda s: F.coalesce(
        F.from_json(F.get_json_object(s, "$.triples"), texts), F.array().cast(texts))))
    chosen = F.when(_has_keys(F.col("text"), "triples"), F.get_json_object("text", "$.triples")).otherwise(
        F.get_json_object("text", "$.extractions"))
    items = (
        F.when(F.col("layout") == "stanford", nested)
        .when(F.col("layout") == "generic", F.from_json(F.coalesce(chosen, F.lit("[]")), texts))
        .when(F.col("layout") != "unknown", F.from_json("text", texts))
    )
    listed = files.withColumn("_items", items)
    return listed.select("source_file", "layout", F.posexplode_outer("_items").alias("triple_ord", "item"),
                         F.col("_items").isNotNull().alias("is_listed"))


def _field(position: int) -> Column:
    item = F.from_json("item", "map<string,string>")
    generic = F.lit("")
    for name in reversed(_GENERIC_FIELDS[position]):
        generic = F.when(F.map_contains_key(item, name), item[name]).otherwise(generic)
    value = generic
    for name, fields in _LAYOUT_FIELDS.items():
        value = F.when(F.col("layout") == name, item[fields[position]]).otherwise(value)
    return value


def _is_object() -> Column:
    return F.json_object_keys("item").isNotNull() & F.from_json("item", "map<string,string>").isNotNull()


def triples(files: DataFrame) -> DataFrame:
    """Triples of files (source_file, text).

    (source_file, triple_ord, subject, relation, object).  Triples with an
    absent or empty part are dropped; the rest is stripped, so a part of
    blanks becomes empty but stays.  What cannot be read at all is left to
    ``quarantine``.
    """
    return _whole_triples(_items(files.withColumn("layout", layout(F.col("text")))))


def _whole_triples(items: DataFrame) -> DataFrame:
    parts = items.filter(_is_object()).select(
        "source_file", F.col("triple_ord").cast("long").alias("triple_ord"),
        _field(0).alias("subject"), _field(1).alias("relation"), _field(2).alias("object"))
    full = reduce(lambda a, b: a & b, [F.col(c) != "" for c in ("subject", "relation", "object")])
    return parts.filter(full).select(
        "source_file", "triple_ord", *[strip(F.col(c)).alias(c) for c in ("subject", "relation", "object")])


def quarantine(files: DataFrame) -> DataFrame:
    """What ``triples`` cannot read: (source_file, position, reason).

    A file of no known layout or without a list of extractions has no position;
    an item that is not an object has its place in the list.
    """
    return _reasons(_items(files.withColumn("layout", layout(F.col("text")))))


def _reasons(items: DataFrame) -> DataFrame:
    reason = (F.when(F.col("layout") == "unknown", "unknown layout")
              .when(~F.col("is_listed"), "no list of extractions")
              .when(F.col("triple_ord").isNotNull() & ~F.coalesce(_is_object(), F.lit(False)), "not an object"))
    return items.select("source_file", F.col("triple_ord").cast("long").alias("position"), reason.alias("reason")).filter(
        F.col("reason").isNotNull())


def read_triples(spark: SparkSession, path: str, suffix: str | None = None) -> DataFrame:
    """Triples of a file or of all files of a folder whose name ends with ``suffix``."""
    return triples(read_files(spark, path, suffix))


def read_triples_and_quarantine(spark: SparkSession, path: str, suffix: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Triples of files, and what could not be read of them."""
    files = read_files(spark, path, suffix)
    return triples(files), quarantine(files)


# Sentences that one step of the running count takes.
_RUN = 4096


def _split_layouts(files: DataFrame, members: DataFrame, items: DataFrame) -> DataFrame:
    """Layout of each file, and the member that holds its list: (source_file, layout, list_ord, is_listed)."""
    def first(name: str) -> Column:
        return F.min(F.when(F.col("key") == name, F.struct("entry_ord", "is_listed", (F.col("value") == "null").alias("is_null")))).alias(name)

    named = members.withColumn("value", F.when(~F.col("is_listed"), F.coalesce("value", F.lit("null")))).groupBy(
        "source_file").agg(*[first(n) for n in ("sentences", "triples", "extractions")])
    opening = items.filter("entry_ord = 0 and position is null").select("source_file", layout(F.concat(F.lit("["), "item", F.lit("]"))).alias("listed"))
    found = files.join(named, "source_file", "left").join(opening, "source_file", "left")
    generic = F.coalesce("triples", "extractions")
    name = (F.when(F.col("is_broken"), "unknown").when(F.col("sentences").isNotNull(), "stanford")
            .when(generic.isNotNull(), "generic").otherwise(F.coalesce("listed", F.lit("unknown"))))
    chosen = F.when(F.col("sentences").isNotNull(), F.col("sentences")).otherwise(generic)
    return found.withColumn("layout", name).select(
        "source_file", "layout", chosen["entry_ord"].alias("list_ord"),
        F.when(F.col("layout").isin("allennlp", "clausie"), True).when(
            F.col("layout") == "generic", chosen["is_listed"] | F.coalesce(chosen["is_null"], F.lit(False))).otherwise(
            F.coalesce(chosen["is_listed"], F.lit(False))).alias("is_listed"))


def _split_items(files: DataFrame, members: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``_items`` from the parts of ``split_json``."""
    layouts = cut_lineage(_split_layouts(files, members, items))
    held = items.join(broadcast_if_small(layouts), "source_file").filter("layout <> 'unknown'")
    plain = held.filter("layout <> 'stanford'").filter(
        F.when(F.col("layout") == "generic", F.col("position").isNotNull() & (F.col("entry_ord") == F.col("list_ord"))).otherwise(
            F.col("position").isNull())).withColumn("triple_ord", F.coalesce("position", "entry_ord"))
    # The position of a triple of a sentence follows from the numbers of triples of all sentences before it.
    inner = F.coalesce(F.from_json(F.get_json_object("item", "$.triples"), "array<string>"), F.array().cast("array<string>"))
    told = held.filter("layout = 'stanford' and position is not null and entry_ord = list_ord").select(
        "source_file", "layout", "position", inner.alias("inner"), F.floor(F.col("position") / _RUN).alias("run"))
    file, run = Window.partitionBy("source_file").orderBy("run"), Window.partitionBy("source_file", "run").orderBy("position")
    before = Window.unboundedPreceding, -1
    runs = told.groupBy("source_file", "run").agg(F.sum(F.size("inner")).alias("n")).select(
        "source_file", "run", F.coalesce(F.sum("n").over(file.rowsBetween(*before)), F.lit(0)).alias("base"))
    counted = told.withColumn("ahead", F.coalesce(F.sum(F.size("inner")).over(run.rowsBetween(*before)), F.lit(0)))
    sentences = counted.join(runs, ["source_file", "run"]).select(
        "source_file", "layout", "base", "ahead", F.posexplode("inner").alias("at", "item")).select(
        "source_file", "layout", (F.col("base") + F.col("ahead") + F.col("at")).alias("triple_ord"), "item", F.lit(True).alias("is_listed"))
    empty = layouts.filter("layout = 'unknown' or not is_listed").select(
        "source_file", "layout", F.lit(None).cast("long").alias("triple_ord"), F.lit(None).cast("string").alias("item"), "is_listed")
    columns = ["source_file", "layout", "triple_ord", "item", "is_listed"]
    return plain.select(columns).unionByName(sentences.select(columns)).unionByName(empty)


def split_triples_and_quarantine(spark: SparkSession, path: str, suffix: str | None = None,
                                 chunk_bytes: int = CHUNK_BYTES) -> tuple[DataFrame, DataFrame]:
    """Triples and quarantine of files that may be larger than a task; a sentence or an item is one value.

    Rows are those of ``read_triples_and_quarantine`` for well-formed files.  A
    file whose brackets do not close has an unknown layout; what stands between
    items is not checked, and one bad item costs only itself.
    """
    items = _split_items(*split_json(spark, path, suffix, chunk_bytes))
    return _whole_triples(items), _reasons(items)


def unread_records(files: DataFrame) -> DataFrame:
    """Files of which ``record_texts`` can read nothing: (source_file, reason)."""
    is_object, is_list = F.json_object_keys("text").isNotNull(), F.from_json("text", "array<string>").isNotNull()
    return files.filter(~(is_object | is_list)).select("source_file", F.lit("neither an object nor a list").alias("reason"))


def record_texts(files: DataFrame) -> DataFrame:
    """Texts of plain records: (source_file, ord, text).

    A record is an object with a sentence, text or surface field, or an array
    whose first element is the text.  A file that is an object of arrays, a
    topic map, gives all its texts.
    """
    elements = F.from_json("text", "array<string>")
    as_map = F.map_values(F.from_json("text", "map<string,string>"))
    inner = F.flatten(F.transform(
        as_map, lambda v: F.coalesce(F.from_json(v, "array<string>"), F.array().cast("array<string>"))))
    is_object = F.json_object_keys("text").isNotNull()
    listed = files.filter(~is_object).select("source_file", F.posexplode(elements).alias("ord", "item"))
    fields = F.from_json("item", "struct<sentence:string,text:string,surface:string>")
    as_array = F.from_json("item", "array<string>")
    text = F.when(F.json_object_keys("item").isNotNull(), first_text(
        fields["sentence"], fields["text"], fields["surface"])).otherwise(F.get(as_array, F.lit(0)))
    mapped = files.filter(is_object).select("source_file", F.posexplode(inner).alias("ord", "text"))
    return listed.select("source_file", "ord", text.alias("text")).unionByName(mapped).filter(
        F.col("text").isNotNull()).withColumn("ord", F.col("ord").cast("long"))
