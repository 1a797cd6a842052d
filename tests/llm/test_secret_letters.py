"""Keys without a digit."""

import re

from fadegraph.llm import secret_scan

ALLOW = re.compile("|".join(f"(?:{p})" for p in secret_scan.ALLOWED))


def test_runs_without_a_digit():
    for key in ("qWz+RtYb/KmVx=PoLdHs", "XbQ/fTr+JyGu+NaEcWiM=", "/kLpZ+uVwQeRtYaSdFgHj"):
        assert secret_scan.entropy_spans(f"a {key} b", ALLOW) == [(2, 3, 2 + len(key))]
    for word in ("Antidisestablishmentarianism", "Some/Path/To_The-Named/File", "lowercase+words=and/more_words", "Ha+Ha+Ha+Ha+Ha+Ha+Ha+Ha"):
        assert secret_scan.entropy_spans(f"a {word} b", ALLOW) == []
    letters = "qWzRtYbKmVxPoLdHsNcE"  # left alone by the allow list only
    assert secret_scan.entropy_spans(letters, ALLOW) == []
    assert secret_scan.entropy_spans(letters, re.compile(r"(?!)")) == [(0, 3, 20)]
