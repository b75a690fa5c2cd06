"""Words that the mix takes of each source, against its target."""

import pytest

from ledgerloom.llm import mixing


def test_a_small_source_beside_a_large_one_gets_its_words(spark, docs_of):
    docs = docs_of(
        [(n, " ".join(["w"] * (90 + n % 7)), "large") for n in range(900)]
        + [(1000 + n, " ".join(["w"] * 40), "five") for n in range(5)]
        + [(2000 + n, " ".join(["w"] * (3 + n % 30)), "two hundred") for n in range(200)])
    got = mixing.mixed(docs, block_words=64).collect()
    for source in ("large", "five", "two hundred"):
        own = [r for r in got if r["source"] == source]
        assert sum(r["taken"] for r in own) == pytest.approx(own[0]["target"], rel=0.01)
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    assert {r["target"] / r["source_size"] for r in got if r["source"] != "large"} == {3.0}
