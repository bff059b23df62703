"""Alignment against both tokenizers on whole texts and plain counting."""

import hashlib
import random
from collections import Counter

import sentencepiece
from tokenizers import Tokenizer

from cloakframe.llm.bpe import _byte_letters
from cloakframe.llm.queries import vocabulary
from cloakframe.llm.token_alignment import align_tokenizers
from tests.llm.test_llm import words

A, B = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")


def plain(rows):
    one, two = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    one.encode_special_tokens = True
    letter = _byte_letters()
    docs = []
    for key, text in rows:
        pairs, groups, a, b = Counter(), [], [], []
        if text:
            a, b = one.encode(" " + text, add_special_tokens=False).ids, two.encode(text)
            raw = [bytes(letter[c] for c in one.id_to_token(i)) for i in a]
            piece = [two.id_to_piece(i) for i in b]
            also = [bytes([int(p[3:5], 16)]) if two.is_byte(i) else b"" if i < 3 else p.replace("▁", " ").encode() for i, p in zip(b, piece)]
            if b"".join(raw) != (" " + text).encode() or b"".join(also) != (" " + text).encode():
                a = b = []
        if a:
            ends = [[len(b"".join(x[: i + 1])) for i in range(len(x))] for x in (raw, also)] if len(a) < 2000 else [[sum(map(len, x[: i + 1])) for i in range(len(x))] for x in (raw, also)]
            i = j = 0
            for cut in sorted(set(ends[0]) & set(ends[1])):
                p, q = ends[0].index(cut) + 1, ends[1].index(cut) + 1
                groups.append((a[i:p], b[j:q]))
                i, j = p, q
            for x, y in groups:
                pairs.update((m, n) for m in x for n in y)
        docs.append((key, len(a), len(b), groups, pairs))
    count = Counter(p for d in docs for p in d[4])
    best = {}
    for (m, _), n in count.items():
        best[m] = max(best.get(m, 0), n)
    out = []
    for key, n_a, n_b, groups, pairs in docs:
        told = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        n_best = sum(k for p, k in pairs.items() if count[p] == best[p[0]])
        out.append((key, n_a, n_b, len(groups), sum(pairs.values()), n_best, sum(k * count[p] for p, k in pairs.items()), hashlib.sha256(told.encode()).hexdigest() if n_a else ""))
    return sorted(out, key=str)


def rows(seed):
    r = random.Random(seed)
    odd = ["", None, " ", "\n", "  a  b ", "a\n b\n\nc\t d", "x <|endoftext|> y </s> <s> <unk> <0x41>", "a▁b", "naïve café — “quote”…", "日本語のテキスト 漢字", "😀 👩‍👩‍👧 é", "don't we'll I'M", "a b　c d", "\x00 \x01", "1234567 3.14 ,,,;;", "if (a) {\r\n\treturn;\r\n}", "aaaa" * 40, "a" + " " * 70 + "b", "﻿bom", "tail ", "tail\n"]
    out = [(i, t) for i, t in enumerate(odd)]
    return out + [(100 + i, words(r, r.randint(1, 60)) + r.choice(["", ".", "\n", "  ", " the the"])) for i in range(120)]


def got(spark, docs, **more):
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, n_a int, chunk string")
    return sorted([tuple(r) for r in align_tokenizers(df, A, B, **more).collect()], key=str)


def test_alignment_is_that_of_whole_texts(spark):
    docs = rows(3)
    docs += docs[:30] + [(None, "a word"), (7, "a word"), (900, words(random.Random(2), 3000))]
    assert got(spark, docs) == plain(docs)


def test_one_range_for_each_partition_gives_the_same(spark):
    docs = rows(4)
    assert got(spark, docs, reach=1) == plain(docs)


def test_many_chunks_give_the_same(spark, monkeypatch):
    from cloakframe.llm import token_alignment as t

    small = t.postings
    monkeypatch.setattr(t, "postings", lambda docs, *a: small(docs.repartition(3), *a, most=1, pairs=50))
    docs = rows(5)
    assert got(spark, docs) == plain(docs)


def test_empty_table(spark):
    assert got(spark, []) == []
    assert got(spark, [(1, None)]) == [(1, 0, 0, 0, 0, 0, 0, "")]
