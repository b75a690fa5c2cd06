"""Mixing, line dedup and chat windows on small tables."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import chat, lines, mixing


def rows(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


# -- mixing --------------------------------------------------------------------


def test_targets_follow_weights_and_stop_at_three_times_the_size(spark, docs_of):
    docs = docs_of([(1, "w " * 10, "a"), (2, "w " * 2, "b"), (3, "w " * 28, "c"), (4, None, None), (5, "", "a")])
    got = {r["source"]: r for r in mixing.mixed(docs, block_words=1).collect()}
    # weights 1, 2, 3, 1; of 40 words b may have 6 and the null source none: the rest by 1 to 3
    assert got["b"]["target"] == 6 and got[None]["target"] == 0
    assert got["a"]["target"] == pytest.approx(34 / 4) and got["c"]["target"] == pytest.approx(34 * 3 / 4)
    assert got["a"]["source_size"] == 10


def test_taken_words_come_near_targets_and_reruns_agree(spark, docs_of):
    rng = random.Random(4)
    docs = docs_of([(i, "w " * rng.randrange(0, 60), f"s{i % 7 if i % 3 else 0}") for i in range(600)])
    got = mixing.mixed(docs).collect()
    assert rows(mixing.mixed(docs), "doc_id", "taken") == sorted(((r["doc_id"], r["taken"]) for r in got), key=repr)
    for source in {r["source"] for r in got}:
        own = [r for r in got if r["source"] == source]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 2
        assert sum(r["size"] for r in own) == own[0]["source_size"]
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in got) and len(got) == 600


def test_apportioned_is_sainte_lague(spark):
    rng = random.Random(8)
    data = [(g, k, rng.randrange(0, 500), 97, 0) for g in range(5) for k in range(9)]
    total = {g: sum(r[2] for r in data if r[0] == g) for g in range(5)}
    data = [(g, k, c, n, -(-n * c // total[g]) + k % 2) for g, k, c, n, _ in data]
    df = spark.createDataFrame(data, "g int, k int, claim bigint, seats bigint, most bigint")
    got = {(r["g"], r["k"]): r["won"] for r in mixing.apportioned(df, ["g"], "claim", "seats", "most", ["k"], "won").collect()}
    for g in range(5):
        own = [r for r in data if r[0] == g]
        quotients = sorted((-(c / (2 * n + 1)), k) for _, k, c, _, most in own for n in range(most) if c)[:97]
        assert {k: sum(q[1] == k for q in quotients) for k in range(9)} == {k: got[g, k] for k in range(9)}


def test_mixing_of_nothing_and_of_repeated_rows(spark, docs_of):
    assert mixing.mixed(docs_of([])).count() == 0
    got = mixing.mixed(docs_of([(1, "a b"), (1, "a b"), (None, "c d"), (2, None)], taken=9)).collect()
    assert len(got) == 4 and sum(r["taken"] for r in got) == 6


# -- line dedup ----------------------------------------------------------------

PASSAGE = "One is here. Two is there. Three is far. Four is near. "


def test_later_passages_go_and_the_first_stays(spark, docs_of):
    docs = docs_of([(3, "Own start. " + PASSAGE + "Own end."), (1, PASSAGE), (2, "One is here. Two is there. Else.")], n_lines=7)
    got = {r["doc_id"]: r for r in lines.without_repeats(docs).collect()}
    assert got[1]["text"] == PASSAGE and got[1]["n_removed"] == 0 and got[1]["n_lines"] == 4
    assert got[3]["text"] == "Own start. Own end." and got[3]["n_removed"] == 4
    assert got[2]["n_removed"] == 0


def test_passages_inside_one_document_and_odd_texts(spark, docs_of):
    cases = [(1, "  \n. A b.\nC d.\nE f.\n\nA b.\nC d.\n E f.\nG."), (2, None), (3, ""), (4, " \n\n"), (5, "x " * 60_000), (None, PASSAGE), (6, PASSAGE), (6, PASSAGE)]
    got = lines.without_repeats(docs_of(cases)).collect()
    by = {r["doc_id"]: r for r in got}
    assert by[1]["text"] == "  \n. A b.\nC d.\nE f.\n\nG." and by[1]["n_removed"] == 3
    assert by[2]["text"] is None and by[2]["n_lines"] == 0 and by[3]["text"] == "" and by[4]["n_lines"] == 0
    assert by[5]["n_removed"] == 0 and len(by[5]["text"]) == 120_000
    assert by[None]["text"] == "" and by[None]["n_removed"] == 4  # null ids come last
    assert [r["n_removed"] for r in got if r["doc_id"] == 6] == [0, 0]  # versions of one document
    assert lines.without_repeats(docs_of([])).count() == 0


@pytest.mark.parametrize("lead", ["", " ", "\t", "\r", "\x0b", "\x0c", "\n", ".", "?!", "é", " é"])
def test_any_first_character(spark, docs_of, lead):
    own = "" if lead.strip(" \t\r\n\x0b\x0c.?!") == "" else "Own. "
    text = lead + own + PASSAGE + "Last."
    got = {r["doc_id"]: r for r in lines.without_repeats(docs_of([(1, PASSAGE), (2, text)])).collect()}
    assert got[2]["text"] == lead + own + "Last." and got[2]["n_removed"] == 4


# -- chat ----------------------------------------------------------------------

TURNS = "conv_id bigint, turn bigint, role string, text string"


@pytest.mark.parametrize("text", ["", "plain", "</s>[INST] ok [/INST]", r"\</s>", r"\\<|im_end|>\ ", "<|im_start|>user\nhi<|im_end|>", "[[INST]<<s>s>\\"])
def test_escape_is_reversible_and_hides_marks(spark, text):
    df = spark.createDataFrame([(text,)], "t string").select(chat.escaped(F.col("t")).alias("e"))
    assert df.select(chat.unescaped(F.col("e"))).first()[0] == text
    assert df.filter(F.rlike("e", F.lit(rf"(?<!\\)(?:{chat.CONTROL})"))).count() == 0


def test_windows_keep_budget_system_history_and_targets(spark):
    rng = random.Random(2)
    turns = [(1, 0, "system", "Be kind.")]
    turns += [(1, n, "assistant" if n % 2 == 0 else "user", f"<s>{n} " + "word " * rng.randrange(0, 90)) for n in range(1, 60)]
    turns += [(2, 5, None, None), (2, None, "assistant", "last"), (2, 5, None, None), (None, 1, "we ird\n", "x\\")]
    df = spark.createDataFrame(turns, TURNS).withColumn("window", F.lit("clash"))
    made = chat.windows(df, budget=256, history_turns=2, history_tokens=64).select(
        "*", chat.parsed(F.col("formatted")).alias("turns"), chat.targets(F.col("formatted"), F.col("loss")).alias("said")).collect()
    own = sorted((r for r in made if r["conv_id"] == 1), key=lambda r: r["first_turn"])
    read = [(t["role"], t["text"]) for r in own for t in r["turns"][r["n_repeated"]:]]
    assert read == [(t[2], t[3]) for t in turns[:60]]
    assert [t for r in own for t in r["said"]] == [t[3] for t in turns[:60] if t[2] == "assistant"]
    assert all(r["n_tokens"] <= 256 for r in own) and len(own) > 5
    for before, r in zip(own, own[1:]):
        assert r["turns"][0]["text"] == "Be kind." and r["n_repeated"] <= 3
        history = [t["text"] for t in r["turns"][1:r["n_repeated"]]]
        assert history == [t[3] for t in turns[r["first_turn"] - 1 - len(history):r["first_turn"] - 1]]
    two = [r for r in made if r["conv_id"] == 2]
    assert [(t["role"], t["text"]) for r in two for t in r["turns"]] == [("", ""), ("", ""), ("assistant", "last")]
    assert [(t["role"], t["text"]) for r in made if r["conv_id"] is None for t in r["turns"]] == [("we ird\n", "x\\")]
    assert chat.windows(spark.createDataFrame([], TURNS)).count() == 0


def test_conversations_digest_against_hashlib(spark, tmp_path):
    from ledgerloom.llm.queries import QUERIES

    turns = [(7, n, ("user", "assistant")[n % 2], f"turn {n} " + "x" * 200 * (n % 5)) for n in range(30)]
    spark.createDataFrame(turns, TURNS).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: r for r in QUERIES["op9_chat"](spark, str(tmp_path)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[7]["turns_sha256"] == sha("".join(f"{t[2]}\n{t[3]}\n" for t in turns)) and got[7]["n_turns"] == 30
    said = "".join(t[3] for t in turns if t[2] == "assistant")
    assert got[7]["loss_sha256"] == sha(said) and got[7]["loss_chars"] == len(said)
    own = "</s>[INST] ok [/INST]"
    assert got[-1]["loss_sha256"] == sha(own) and got[-1]["turns_sha256"] == sha(f"user\n{own}\nassistant\n{own}\n")
