"""Merkle manifests against a plain tree of lists."""

import hashlib
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import merkle

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(r, text):
    parts = [r[0], r[3], r[2], r[4], text]
    return sha("".join("-" if p is None else f"{len(str(p).encode())}:{p}" for p in parts))


def climbed(nodes):
    """Digest of the top, and each node's siblings level by level."""
    paths, places = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i:i + 8] for i in range(0, len(nodes), 8)]
        for who, at in enumerate(places):
            run = runs[at // 8]
            paths[who].append(("".join(run[:at % 8]), "".join(run[at % 8 + 1:])))
        nodes, places = [sha("".join(run)) for run in runs], [p // 8 for p in places]
    return nodes[0], paths


def expected(rows):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = []
    for lang in langs:
        own = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        trees.append((own, *climbed([leaf(r, r[1]) for r in own])))
    root, high = climbed([t[1] for t in trees])
    out = []
    for (own, subroot, paths), above in zip(trees, high):
        for r, path in zip(own, paths):
            text = r[1]
            if r[0] is not None and text is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            node = leaf(r, text)
            for left, right in path + above:
                node = sha(left + node + right)
            out.append((r[0], leaf(r, r[1]), subroot, root, sha("".join(a + b for a, b in path + above)), node, node == root))
    return sorted(out, key=repr)


def got_of(spark, rows, tmp_path, **extra):
    from ledgerloom.llm.queries import QUERIES

    folder = str(tmp_path / f"t{random.random()}")
    spark.createDataFrame(rows, COLUMNS).withColumns({k: F.lit(v) for k, v in extra.items()}).write.parquet(f"{folder}/documents.parquet")
    return sorted((tuple(r) for r in QUERIES["op13_manifest"](spark, folder).collect()), key=repr), folder


def many(rng):
    ids = rng.sample(range(-3000, 70_000), 700) + [2**62, -2**63, 2**63 - 1]
    rows = [(i, rng.choice(["Ab", "ÀB c", "", None, "x" * 90_000 if i % 97 == 0 else "Y"]), rng.choice(["en", "en", "en", "de", "fr"]), "s", 3) for i in ids]
    rows += [(7, "one", "zz", None, None), (-1, "T", None, "s", 1), (-2, "U", None, "s", 1)]
    return rows


def repeated(rng):
    rows = [(5, "Same", "en", "s", 4)] * 30 + [(5, f"T{i}", "en", "s", 2) for i in range(40)] + [(None, "Null id", "en", "s", 1)] * 9
    return rows + [(None, "Other", "en", "s", 1), (None, None, None, None, None)] + [(i, "A", "en", "s", 1) for i in range(0, 90, 7)]


@pytest.mark.parametrize("make", [many, repeated, lambda rng: [(1, "Alone", "en", "s", 5)], lambda rng: [(i, "B", f"l{i}", "s", 5) for i in range(70)]])
def test_manifest_against_plain_trees_and_sql(spark, tmp_path, make):
    rows = make(random.Random(13))
    got, folder = got_of(spark, rows, tmp_path, idx=1, tree="clash", word=2.5, claim="x", slots="y")
    assert got == expected(rows)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    assert sorted(con.sql(merkle.MANIFEST_SQL).fetchall(), key=repr) == got
    con.close()


def test_copies_beyond_one_stretch_and_nothing(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(merkle, "COPIES", 4)
    rows = [(5, "Same", "en", "s", 4)] * 23 + [(6, "Next", "en", "s", 4)] * 4 + [(9, "Last", "en", "s", 1)]
    assert got_of(spark, rows, tmp_path)[0] == expected(rows)
    assert got_of(spark, [], tmp_path)[0] == []
