"""Neighbours, tokens, toxicity, counts, near-duplicates, language model and leaks."""

import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models

from ledgerloom.llm import components, kneser, leaks, near, neighbours, repair, toxic
from ledgerloom.llm.counts import PieceCounts, token_counts

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", "  \n\t", "x\x1cy\x85z", "It's 'S <|endoftext|> É é", "word " * 30_000, "tie", "tie"]


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{int(rng.paretovariate(0.7)) % vocabulary}" for _ in range(n))


# -- neighbours ----------------------------------------------------------------

VECTORS = "vec_id bigint, embedding array<float>, label int"


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(900, 12)).astype(np.float32)
    x[300:600] = x[7]  # a third of all rows is one vector
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], VECTORS)
    got = {}
    for r in neighbours.nearest(df, df.filter("vec_id % 100 = 0")).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["score"], r["vec_id"]))
    hit = 0
    for q in range(0, 900, 100):
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        d[q] = np.inf
        want = np.lexsort((np.arange(900), d))[:10]
        found = sorted(got[q])
        assert [r[0] for r in found] == list(range(1, 11)) and [r[1:] for r in found] == sorted(r[1:] for r in found)
        assert all(math.isclose(d[v], s, rel_tol=1e-12, abs_tol=0) or d[v] == s for _, s, v in found)
        hit += len({v for *_, v in found} & set(want.tolist()))
    assert hit >= 0.9 * 90
    assert [v for *_, v in sorted(got[300])] == [7, *range(301, 310)]


def test_vectors_that_take_no_part(spark):
    rows = [(0, [1.0, 2.0], 0), (1, None, 0), (2, [0.0, 0.0], 0), (3, [float("nan"), 1.0], 0), (4, [None, 1.0], 0),
            (5, [float("inf"), 1.0], 0), (6, [1.0, 2.0, 3.0], 0), (7, [1.0, 3.0], 0), (7, [1.0, 3.0], 0), (None, [1.0, 1.0], 0)]
    df = spark.createDataFrame(rows, VECTORS)
    assert [tuple(r) for r in neighbours.nearest(df, df.filter("vec_id = 0 OR vec_id = 2")).collect()] == [(0, 1, 7, 1.0)]
    assert neighbours.nearest(df.limit(0), df).count() == 0 and neighbours.nearest(df, df.limit(0)).count() == 0


def test_probes_rise_by_summed_distance():
    rng = np.random.default_rng(2)
    q = neighbours.Quantiser((rng.normal(size=(7, 2)), rng.normal(size=(6, 3))), 1.0)
    v = rng.normal(size=(1, 5))
    (cells,) = q.probes(v, np.ones(42, int))
    a, b = q.distances(v)
    sums = [a[0][c // 6] + b[0][c % 6] for c in cells]
    assert sorted(cells) == list(range(42)) and sums == sorted(sums)


# -- token shards --------------------------------------------------------------


def test_tokens_round_trip_against_the_tokenizer(spark, docs_of):
    rng = random.Random(3)
    cases = [(i, t) for i, t in enumerate(ODD)] + [(100 - i, prose(rng, 300)) for i in range(40)] + [(None, "no id")]
    folder = repair.shared_folder(spark)
    repair.write_tokens(docs_of(cases), WORD_BPE, folder, shard_bytes=20_000)
    got = repair.read_tokens(spark, folder).collect()
    plain = Tokenizer.from_file(WORD_BPE)
    start = 0
    by = {r["doc_id"]: r for r in got}
    for doc, text in sorted(cases, key=lambda c: (c[0] is None, c[0])):
        ids = plain.encode(text or "", add_special_tokens=False).ids + [2]
        assert (by[doc]["start"], by[doc]["n_tokens"]) == (start, len(ids))
        assert by[doc]["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    shard = max(spark.read.parquet(folder).collect(), key=lambda r: len(r["doc_ids"])).asDict()
    for n, doc in enumerate(shard["doc_ids"]):
        text = dict((c[0], c[1]) for c in cases)[doc]
        assert repair.document(shard, n).tolist() == plain.encode(text or "", add_special_tokens=False).ids + [2]
    assert repair.encoded(docs_of([]), WORD_BPE).count() == 0


def test_ids_are_the_librarys_for_odd_texts():
    rng = random.Random(17)
    odd = list("aAzZ.,'’-0٣ \t\x1c\x85\u00a0\u2028İıßſΣςǅﬁéE\u0301\u0307中한ᄀ각🙂\u200d\u0345") + [
        "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "<|", "|>", "word", "Word,", "İ.", "KK ΣBİ,", "z İ."]
    texts = ["".join(rng.choices(odd, k=rng.randrange(0, 12))) for _ in range(30_000)]
    texts += ["".join(chr(rng.choice((rng.randrange(1, 0xD800), rng.randrange(0xE000, 0x2FA20)))) for _ in range(8)) + "." for _ in range(5_000)]
    own = repair.WordIds(WORD_BPE).texts(texts)
    plain = Tokenizer.from_file(WORD_BPE).encode_batch(texts, add_special_tokens=False)
    wrong = [(t, o.tolist(), p.ids) for t, o, p in zip(texts, own, plain) if o.tolist() != [*p.ids, 2]]
    assert not wrong, wrong[:5]


@pytest.mark.parametrize("ids", [[], [5], [5, 5, 5, 5, 5, 5, 5, 2], [1, 3] * 50 + [2], [2, 2, 2], [7] * 101])
def test_repair_expands_to_what_it_was(ids):
    flat = np.array(ids, np.int32)
    rules, sequence = repair.compressed(flat, least=2, rounds=30)
    base = int(flat.max(initial=0)) + 1
    assert repair.expanded(sequence, rules, base).tolist() == ids
    assert len(repair.lengths(rules, base)) == len(rules)
    assert len(ids) < 8 or len(sequence) <= len(ids) // 2


def test_documents_that_hold_the_end_id_inside():
    ids = [np.array([4, 2, 4, 2, 9, 2]), np.array([2]), np.array([4, 2, 4, 2])]
    shard = repair.shard_of(ids)
    assert [repair.document(shard, n).tolist() for n in range(3)] == [i.tolist() for i in ids]


# -- toxicity ------------------------------------------------------------------


def test_toxicity_learns_words_and_their_misspellings(spark, docs_of):
    rng = random.Random(5)
    bad = ["worthless", "pathetic", "disgusting"]
    cases, labels = [], []
    for i in range(600):
        text = prose(rng, 40).split()
        if i % 3 == 0:
            for _ in range(3):
                text.insert(rng.randrange(len(text)), rng.choice(bad))
        cases.append((i, " ".join(text)))
        labels.append((i, 0, int(i % 3 == 0)))
    odd = [(1000 + i, t) for i, t in enumerate(ODD)] + [(2000, prose(rng, 40) + " worthles pathettic disgustin"), (None, "clean")]
    docs = docs_of(cases + odd, score=9)
    table = spark.createDataFrame(labels + [(3, 1, None), (None, 1, 1), (1, 0, 0)], "doc_id bigint, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxic.scored(docs, table).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["held_out"] == (i in held) for i in range(600))
    assert sum(got[i]["predicted"] == (i % 3 == 0) for i in held) >= 0.97 * len(held)
    assert got[2000]["predicted"] == 1 and got[1000]["predicted"] == 0
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[1000]["score"] == got[1001]["score"]
    flat = toxic.scored(docs_of([(1, "a")]), table.limit(0)).collect()
    assert len(flat) == 1 and 0 <= flat[0]["score"] <= 1


# -- token counts --------------------------------------------------------------


def test_counts_are_those_of_the_unigram_tokenizer(spark, docs_of):
    counts = PieceCounts.of_model(PIECES)
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    plain = Tokenizer(models.Unigram([(m.id_to_piece(i), m.get_score(i)) for i in range(m.get_piece_size())], 0, True))
    rng = random.Random(6)
    texts = [t for t in ODD if t] + ["a   b", "é梦벨\x00", "\U0001f600▁x", " lead", "trail  "]
    texts += ["".join(rng.choice("the anon ré.\n梦") for _ in range(80)) for _ in range(60)]
    for text in texts:
        assert counts.text(text)[1] == len(plain.encode("▁" + text.replace(" ", "▁")).ids)
    df = docs_of(list(enumerate(texts)) + [(998, None), (999, "")])
    got = {r[0]: r[1] for r in df.select("doc_id", token_counts(F.col("text"), PIECES)["n_tokens"]).collect()}
    assert got[998] == got[999] == 0 and all(got[i] == counts.text(t)[1] for i, t in enumerate(texts))


def test_ties_go_to_the_path_that_starts_earlier():
    pieces = {"▁": -1.0, "a": -2.0, "b": -2.0, "ab": -4.0, "▁a": -3.0, "▁ab": -5.0}
    counts = PieceCounts(pieces, True)
    assert counts.text("ab") == (-5.0, 1) and counts.text("aéb")[1] == 1 + 2 + 1
    crossing = PieceCounts(pieces | {"a▁b": -1.0}, True)
    assert not crossing.cuts and crossing.text("a b") == (-2.0, 2)


# -- near-duplicates -----------------------------------------------------------


def brute_components(sets, percent):
    root = {i: i for i in sets}

    def top(x):
        return x if root[x] == x else top(root[x])

    for a, b in itertools.combinations(sorted(sets), 2):
        common = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
            x, y = sorted((top(a), top(b)))
            root[y] = x
    return {i: top(i) for i in sets}


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates_against_brute_force(spark, docs_of, width):
    rng = random.Random(7)
    cases = [(i, t) for i, t in enumerate(ODD)]
    base = [prose(rng, 120, 5000).split() for _ in range(12)]
    for i in range(260):  # one group of a third of all rows, copies of copies, and others
        own = list(base[0] if i % 3 == 0 else base[i % 12])
        for _ in range(rng.choice([0, 0, 1, 3, 6])):
            own[rng.randrange(len(own))] = f"z{rng.randrange(50)}"
        cases.append((1000 - i, (" " if i % 2 else "\n").join(own).upper() if i % 5 == 0 else " ".join(own)))
    got = {r["doc_id"]: r for r in near.near_duplicates(docs_of(cases + [(None, "a b c")], kept=1), width).collect()}
    sets = {}
    for i, t in cases:
        w = (t or "").lower().encode().split()
        sets[i] = {tuple(w[k:k + width]) for k in range(len(w) - width + 1)} or ({tuple(w)} if w else set())
    want = brute_components(sets, 80)
    assert {i: got[i]["component_id"] for i in sets} == want
    assert all(got[i]["n_shingles"] == len(s) and got[i]["kept"] == (want[i] == i) for i, s in sets.items())
    assert got[None]["kept"] and got[None]["component_id"] is None
    assert near.near_duplicates(docs_of([])).count() == 0


def test_blocks_find_links_between_components_only():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 200, 60)).astype(np.int64) for _ in range(6)]
    sets += [np.unique(np.append(s[:-1], 999 + i)) for i, s in enumerate(sets)]
    nodes, roots = np.arange(12), np.array([0, 1, 2, 3, 4, 5, 0, 7, 8, 9, 10, 11])
    found = near._joined(nodes, roots, np.zeros(12, int), sets, 80)
    assert sorted(tuple(sorted(p)) for p in found) == [(k, k + 6) for k in range(1, 6)]
    sides = np.array([0] * 6 + [1] * 6)
    assert sorted(near._joined(nodes, roots, sides, sets, 80)) == [(k, k + 6) for k in range(1, 6)]


def test_components_of_long_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5, 5), (5000, 4000), (4000, 5000)]
    df = spark.createDataFrame(links, "a bigint, b bigint")
    got = {r["node"]: r["root"] for r in components.components(df).collect()}
    assert got == {**{i: 0 for i in range(201)}, **{1000 + i: 1000 for i in range(300)}, 4000: 4000, 5000: 4000}


# -- language model ------------------------------------------------------------


def test_kneser_ney_against_its_formulas(spark, docs_of):
    rng = random.Random(9)
    cases = [(i, t) for i, t in enumerate(ODD)] + [(i + 10, prose(rng, 120, 300)) for i in range(80)] + [(None, "w1 w2")]
    docs = docs_of(cases, score=1).withColumn("held_out", kneser.held_out(F.col("doc_id")))
    got = {r["doc_id"]: r for r in kneser.scored(docs, kneser.train(docs.filter("NOT held_out"), 1 << 12)).collect()}
    tokens = {i: (t or "").encode().lower().split() + [None] for i, t in cases}
    held = {i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i in tokens}
    pairs, words = Counter(), Counter()
    for i, w in tokens.items():
        if not held[i]:
            pairs.update(zip(["start", *w[:-1]], w))
            words.update(w)
    n, kinds = sum(words.values()), len(words)
    firsts = Counter(b for _, b in pairs)
    off = [kneser.discounts(*[sum(c == k for c in t.values()) for k in (1, 2, 3, 4)]) for t in (pairs, firsts)]
    context, rest = Counter(), Counter()
    for (a, _), c in pairs.items():
        context[a] += c
        rest[a] += off[0][min(c, 3)]
    taken = sum(off[1][min(c, 3)] for c in firsts.values())

    def low(b):
        return (max(firsts[b] - off[1][min(firsts[b], 3)], 0) + taken / (kinds + 1)) / len(pairs)

    def p(a, b):
        if not context[a]:
            return low(b)
        c = pairs[a, b]
        return max(c - off[0][min(c, 3)], 0) / context[a] + rest[a] / context[a] * low(b)

    assert sum(p("start", b) for b in words) + low("never") * rest["start"] / context["start"] == pytest.approx(1)
    for i, w in tokens.items():
        want = sum(math.log10(p(a, b)) for a, b in zip(["start", *w[:-1]], w))
        assert got[i]["score"] == pytest.approx(want, rel=1e-9) and got[i]["held_out"] == held[i]
        assert got[i]["base_score"] == pytest.approx(sum(math.log10((words[b] + 1) / (n + kinds + 1)) for b in w))
        assert (got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"]) == (len(w), sum(b in words for b in w), n)
    none = docs_of([]).withColumn("held_out", F.lit(False))
    model = kneser.train(none)
    assert kneser.scored(none, model).count() == 0 and kneser.scored(docs, model).count() == len(cases)


# -- leaks ---------------------------------------------------------------------

ITEM = "Which of the old rivers runs past the seven tall towers of the town? It is the long grey river Aue."


def test_leaks_need_question_and_answer(spark, docs_of):
    rng = random.Random(10)
    long = " ".join(f"q{i}" for i in range(230)) + ". " + " ".join(f"a{i}" for i in range(12)) + "."
    items = [(1, ITEM), (2, "Short one here now. Yes indeed."), (3, long), (4, None), (5, ""), (1, ITEM)]
    noise = prose(rng, 400)
    cases = [(i, t) for i, t in enumerate(ODD)] + [
        (10, f"{noise} {ITEM.upper().replace(' ', '  ')} {noise}"),
        (11, f"{noise} {ITEM.split('?')[0]}? {noise}"),
        (12, f"{noise} {ITEM.split('?')[1]} {noise}"),
        (13, f"{noise}\n{long}\n{ITEM}"), (14, noise), (None, ITEM)]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    found = leaks.with_leaks(docs_of(cases, leaks=0), bench).select("doc_id", F.explode("leaks.item_id").alias("item")).collect()
    assert sorted(map(tuple, found), key=repr) == sorted([(10, 1), (13, 1), (13, 3), (None, 1)], key=repr)
    assert leaks.with_leaks(docs_of(cases), bench.limit(0)).filter(F.size("leaks") > 0).count() == 0


def test_block_max_search_finds_all_above_the_threshold():
    rng = random.Random(11)
    postings = [(e, f"t{t}".encode(), rng.random() / 6) for e in range(300) for t in rng.sample(range(60), 12)]
    shard = leaks.Shard(postings, [(e, "x") for e in range(300)], list(range(300)))
    for threshold in (0.2, 0.5, 0.8):
        for _ in range(20):
            terms = rng.sample(range(60), 25)
            names = {t: k for t, k in shard.terms.items()}
            query = [names[f"t{t}".encode()] for t in terms]
            sums = Counter()
            for e, t, i in postings:
                if int(t[1:]) in terms:
                    sums[e] += i
            want = {e: s for e, s in sums.items() if s >= threshold}
            got = dict(shard.search(query, threshold))
            assert got.keys() == want.keys() and all(math.isclose(got[e], want[e]) for e in want)
            cut = [x for low in range(0, 300, 70) for x in shard.search(query, threshold, low, low + 70)]
            assert sorted(e for e, _ in cut) == sorted(got) and all(math.isclose(got[e], s) for e, s in cut)


# -- pipeline ------------------------------------------------------------------


def test_pipeline_stages_take_effect(spark, docs_of, tmp_path):
    import corpus_pipeline as pipeline

    rng = random.Random(12)
    cases = [(i, prose(rng, 60 + i % 40, 3000), f"s{i % 3}") for i in range(150)]
    cases += [(500 + i, cases[i][1], "s1") for i in range(30)] + [(600, prose(rng, 50) + " " + ITEM, "s2"), (None, "left alone", "s0"), (700, None, None)]
    docs_of(cases).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    names = [n for n, _ in pipeline.STAGES]
    assert len(names) == 5
    kept = {}
    for name, stage in pipeline.STAGES:
        docs = pipeline.stored(stage(spark, docs, str(tmp_path)))
        kept[name] = docs.select("doc_id").collect()
        assert name == names[-1] or docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = {n: Counter(r[0] for r in k) for n, k in kept.items()}
    assert ids["toxicity"].total() == len(cases)
    assert not any(i in ids["near duplicates"] for i in range(500, 530)) and 600 in ids["near duplicates"]
    assert 600 not in ids["decontamination"] and ids["decontamination"].total() == 152
    assert max(ids["mixing"].values()) <= 3 and ids["tokens"] == ids["mixing"]
    assert pipeline.run(spark, str(tmp_path)).count() == ids["tokens"].total()
