"""Ids of texts by pieces: what is left to the library, and that they equal its own."""

import random

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from ledgerloom.llm import repair  # noqa: E402

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_each_piece_is_merged_once_whatever_signs_are_beside_it():
    own, asked = repair.WordIds(PATH), []
    library, own.tokenizer = own.tokenizer, None  # plain texts never go through the whole tokenizer
    merges = own.merges
    own.merges = lambda piece: asked.append(piece) or merges(piece)
    texts = ["thndenwh. Thndenwh, (thndenwh) THNDENWH!! don't", "schößlich thndenwh;", "SCHÖSSLICH schößlich... 12"]
    for _ in range(2):
        for text, ids in zip(texts, own.texts(texts)):
            assert ids.tolist() == library.encode(text, add_special_tokens=False).ids + [repair.END_ID]
    assert len(asked) == len(set(asked)) and sum("thndenwh" in a for a in asked) == 1


@pytest.mark.parametrize("limit", [1 << 19, 60])
def test_ids_equal_the_library_s_own(limit, monkeypatch):
    monkeypatch.setattr(repair.WordIds, "LIMIT", limit)
    plain, own, draw = Tokenizer.from_file(PATH), repair.WordIds(PATH), random.Random(3)
    signs = [repair.SIGNS, repair.SIGNS + "\x1c\x85́İΣ\xb5\xaa中٣", "abcAB'sST.,!<|> \n12"]
    special = ["<|endoftext|>", "<|ENDOFTEXT|>", " <|startoftext|>x", "'LL", "a" * 300, " "]
    for _ in range(8):
        texts = ["".join(draw.choices(draw.choice(signs), k=draw.randint(0, 30))) + draw.choice(special) for _ in range(200)]
        texts += ["", None]
        for text, ids in zip(texts, own.texts(texts)):
            assert ids.tolist() == plain.encode(text or "", add_special_tokens=False).ids + [repair.END_ID], text
        assert max(own.known.to_pylist(), key=len, default="") != "a" * 300


def test_rules_that_hold_later_rules_have_their_lengths():
    rules = np.array([[0, 1], [3, 3], [4, 2]])
    assert repair.lengths(rules, 3).tolist() == [2, 4, 5]
    assert repair.expanded(np.array([5, 1, 4]), rules, 3).tolist() == [0, 1, 0, 1, 2, 1, 0, 1, 0, 1]


def test_a_stretch_of_letters_is_a_piece_without_a_look_for_its_ends(monkeypatch):
    plain, own, cut = Tokenizer.from_file(PATH), repair.WordIds(PATH), []
    replace = repair.pc.replace_substring_regex
    monkeypatch.setattr(repair.pc, "replace_substring_regex", lambda x, *a: cut.extend(x.to_pylist()) or replace(x, *a))
    texts = ["Schöße and ÿð it's (and) and, 12", "", "and\nÉtude ×and÷ and"]
    for text, ids in zip(texts, own.texts(texts)):
        assert ids.tolist() == plain.encode(text, add_special_tokens=False).ids + [repair.END_ID]
    assert sorted(cut) == ["(and)", "12", "and,", "it's", "×and÷"]
    small = repair.SIGNS.lower()
    letters = repair.pc.utf8_is_alpha(repair.pa.array(list(small))).to_pylist()
    assert letters == [repair.re.fullmatch(f"[{repair.LETTERS}]", c) is not None for c in small]


def test_a_symbol_is_opened_once_for_all_its_places(monkeypatch):
    rules, asked = np.array([[0, 1], [3, 3], [4, 2]]), []
    expanded = repair.expanded
    monkeypatch.setattr(repair, "expanded", lambda symbols, *a: asked.extend(symbols.tolist()) or expanded(symbols, *a))
    sequence, size = np.array([5, 1, 4, 5, 5, 0, 4]), np.array([1, 1, 1, 2, 4, 5])
    assert repair.opened(sequence, rules, 3, size).tolist() == expanded(sequence, rules, 3).tolist()
    assert asked == [0, 1, 4, 5]
    assert repair.opened(sequence[:0], rules, 3, size).tolist() == []


def test_pairs_have_their_places_in_order_however_wide_they_are():
    draw = np.random.default_rng(5)
    left, right, near = draw.integers(0, 9, 500, np.int32), draw.integers(0, 9, 500, np.int32), np.arange(500) * 3
    wanted = sorted(zip(left.tolist(), right.tolist(), near.tolist()))
    for width in (4, 30):  # pair and place in one number, and apart
        keys, places = repair.by_pair(left, right, near, width)
        assert [(k >> width, k & ((1 << width) - 1), p) for k, p in zip(keys.tolist(), places.tolist())] == wanted
