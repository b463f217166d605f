import random
import unicodedata
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from stridemill.llm.packing import configurations, encoder, layout
from stridemill.llm.token_counts import PieceCounter, count_tokens
from stridemill.llm.token_queries import op2_token_counts, op5_packing

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")


def odd_texts(seed, n=400):
    draw = random.Random(seed)
    texts = ["", " ", "a", "  a  b   ", "<s></s><unk>", "\0x\0", "▁▁a ▁ b", "日本語テキスト漢字" * 30, "a" * 900, "=-" * 200,
             "ab" * 300, " " * 500, "é́ İ 👩‍👩‍👧 ΑΣ don't 'S <|endoftext|>x <|startoftext|>", "|\x1cI \x85\xa0\r\x0b x"]
    texts += ["".join(draw.choice("abcehinors  \n\t=-_▁01é日'<|>.,\x1c\xa0Σς") for _ in range(draw.randint(0, 90))) for _ in range(n)]
    return texts + ["".join(draw.choice("abcehinorst") for _ in range(1500))]


def test_merging_equals_the_library():
    texts = odd_texts(1)
    want = [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=PIECES).encode(texts, num_threads=1)]
    tool = PieceCounter(PIECES)
    assert tool.count(texts).tolist() == want
    assert tool.count(texts[::-1]).tolist() == want[::-1]


def test_token_query(spark, make_docs, as_tables):
    texts = [*odd_texts(2, 60), None, "long word " * 9000]
    rows = [(i, t, None, None) for i, t in enumerate(texts)] + [(None, "x", None, None), (3, "x", None, None), (3, "x", None, None)]
    got = op2_token_counts(spark, as_tables(documents=make_docs(rows).repartition(3))).collect()
    tool = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    want = sorted((-1 if i is None else i, len((t or "").encode()), len(tool.encode(t or "")), len(tool.encode(t or "")) > 4096)
                  for i, t, _, _ in rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got) == want


def test_token_counts_keep_clashing_columns_and_empty_tables(spark, make_docs):
    out = count_tokens(make_docs([(2 ** 60 + 1, "a b", None, "s"), (None, None, None, None)]), "text", PIECES)
    assert {r.row.doc_id for r in out.collect()} == {2 ** 60 + 1, None}
    assert count_tokens(make_docs([]), "text", PIECES).collect() == []


def test_word_encoder_equals_the_library():
    texts = odd_texts(3)
    library = Tokenizer.from_file(WORDS)
    want = [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
    assert [list(map(int, x)) for x in encoder(WORDS).encode(pa.array(texts))] == want


def test_word_encoder_equals_the_library_on_letters_that_lower_to_marks():
    draw = random.Random(23)
    pool = ["İ", "i̇", "I", "ı", "́", "̇", "한", "각", "ß", "Σ", "ς", "ǰ", "ﬁ", "ά", "豈", "é", "<|startoftext|>", "<|endoftext|>", "<|", "'s", "'",
            "#", "-", ",", ".", "_", "0", "9", "a", "B", "zz", " ", "  ", "\n", "\t", "\x00", "\x1c", "\x85", "\xa0", "日", "👩", "‍"]
    texts = ["Ali İ. Yılmaz", "TBMM İ-2", "Sİ, bu", "İstanbul. İ!", "İ#X"]
    texts += ["".join(draw.choices(pool, k=draw.randrange(1, 14))) for _ in range(15_000)]
    library = Tokenizer.from_file(WORDS)
    want = [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
    got = [list(map(int, x)) for x in encoder(WORDS).encode(pa.array(texts))]
    assert [t for t, a, b in zip(texts, got, want) if a != b] == []


def test_word_encoder_composes_letters_like_the_library():
    words = [unicodedata.normalize("NFD", "한국어"), "\u1f71", "\uf900", "λ\u1f79γος", "한국어", "\uf900\u8c48"]
    assert all(w.isalpha() and w == w.lower() for w in words)
    texts = [*words, " ".join(words), "plain " + words[0] + " words, " + words[1]]
    library = Tokenizer.from_file(WORDS)
    want = [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
    assert [list(map(int, x)) for x in encoder(WORDS).encode(pa.array(texts))] == want


def check_packing(rows, got):
    library = Tokenizer.from_file(WORDS)
    want = defaultdict(int)
    for i, t, _, _ in rows:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        for k, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at:at + 2048]
            want[(i, k, at, len(part), zlib.crc32(part.tobytes()))] += 1
    have, places = defaultdict(int), defaultdict(list)
    for r in got:
        have[(r.doc_id, r.piece, r.start, r.length, r.ids_crc32)] += 1
        places[r.sequence_id].append((r.offset, r.length))
    assert have == want
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    rooms = []
    for length in sorted((k[3] for k, n in want.items() for _ in range(n)), reverse=True):
        fit = next((i for i, room in enumerate(rooms) if room >= length), None)
        if fit is None:
            rooms.append(2048)
            fit = -1
        rooms[fit] -= length
    return len(places), len(rooms)


def test_packing_query(spark, make_docs, as_tables):
    draw = random.Random(4)
    words = ["alpha", "beta,", "Gamma.", "delta", "épsilon"]
    texts = [" ".join(draw.choices(words, k=draw.choice([1, 20, 300, 900, 1600, 5000]))) for _ in range(160)]
    rows = [(i, t, None, None) for i, t in enumerate(texts)] + [(900, None, None, None), (901, "", None, None), (902, "", None, None),
                                                               (None, "x", None, None), (5, texts[5], None, None)]
    got = op5_packing(spark, as_tables(documents=make_docs(rows).repartition(3))).collect()
    used, first_fit = check_packing(rows, got)
    assert used <= first_fit + 1


def test_packing_nothing(spark, make_docs, as_tables):
    assert op5_packing(spark, as_tables(documents=make_docs([]))).collect() == []


@pytest.mark.parametrize("counts, best", [
    ({1500: 1000, 700: 900, 1100: 50}, 1475), ({2048: 7, 1: 5}, 8), ({1024: 9}, 5), ({683: 5}, 3), ({5: 3}, 1), ({}, 0)])
def test_layout(counts, best):
    plan = layout(counts)
    assert plan.sequences == best and not any(plan.left.values())


def test_layout_is_near_the_bound_and_of_bounded_size():
    draw = np.random.default_rng(0)
    lengths = np.minimum(2048, draw.lognormal(6, 1, 200_000).astype(int) + 1)
    counts = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True))))
    plan = layout(counts)
    assert plan.sequences <= 1.01 * -(-lengths.sum() // 2048) and len(plan.runs) < 40_000


def test_configurations_cover_no_more_than_asked():
    sizes, demand = [1400, 1000, 640], [10, 30, 100]
    for pattern, times in (found := configurations(sizes, demand, 2048)):
        assert (pattern * sizes).sum() <= 2048 and times > 0
    assert all(sum(p[i] * t for p, t in found) <= demand[i] for i in range(3))
