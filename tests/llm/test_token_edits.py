"""count_edited() and trees that are kept between versions against the tokenizers library on the edited texts."""

import random

from pyspark.sql import functions as F

from cloakframe.llm.queries import vocabulary
from cloakframe.llm.token_edits import apply_edits, count_edited, token_trees

PATH = vocabulary("byte_bpe_50k.json")
LETTERS = "abcdeéß \n\t'sretvl0159.,!?<|endoftext|>日本"
SCHEMA = "doc_id long, text string, edits array<struct<start:int,end:int,text:string>>, leaves string"


def made(n, seed=3):
    r = random.Random(seed)
    say = lambda k: "".join(r.choice(LETTERS) for _ in range(k))
    rows = [(i, say(r.randint(0, 900)), [(r.randint(0, 900), r.randint(0, 950), say(r.randint(0, 12))) for _ in range(r.randint(0, 4))], "x") for i in range(n)]
    rows += [(1000, None, [(0, 0, "new")], "x"), (1001, "", None, "x"), (1002, "plain text", None, "x"), (1003, "abc", [(None, None, None), None, (1, 2, "Z")], "x"), (3, rows[3][1], rows[3][2], "x")]
    rows.append((1004, " ".join(["word"] * 40_000) + "<|endoftext|>", [(100_000, 100_004, ""), (10, 10, " x"), (200_000, 300_000, "<|endof")], "x"))
    return rows


def after(text, edits):
    text = text or ""
    for e in edits or []:
        if e is not None:
            a = min(max(e[0] or 0, 0), len(text))
            b = min(max(e[1] or 0, a), len(text))
            text = text[:a] + (e[2] or "") + text[b:]
    return text


def size(text):
    from tokenizers import Tokenizer

    size.lib = getattr(size, "lib", None) or Tokenizer.from_file(PATH)
    return len(size.lib.encode(text, add_special_tokens=False).ids)


def test_counts_equal_the_library(spark):
    rows = made(60)
    got = count_edited(spark.createDataFrame(rows, SCHEMA), PATH).collect()
    want = sorted((i, size(t or ""), size(after(t, e)), len(after(t, e))) for i, t, e, _ in rows)
    assert sorted((r.doc_id, r.n_tokens, r.n_tokens_edited, r.n_chars_edited) for r in got) == want
    by = {r.doc_id: r.n_chars_reencoded for r in got}
    assert by[1001] == by[1002] == 0 and by[1004] < 3_000  # only what edits touch is encoded again
    assert count_edited(spark.createDataFrame([], SCHEMA), PATH).count() == 0


def test_trees_are_kept_between_versions(spark, tmp_path):
    rows = made(20, 8)
    docs = spark.createDataFrame(rows, SCHEMA)
    token_trees(docs, PATH).write.parquet(str(tmp_path / "v0"))
    texts = {i: t or "" for i, t, _, _ in rows}
    r = random.Random(2)
    for v in range(3):
        some = {i: [(r.randint(0, 50), r.randint(0, 90), "edit é")] for i in texts if r.random() < 0.5}
        edits = spark.createDataFrame([(i, e) for i, e in some.items()], "doc_id long, edits array<struct<start:int,end:int,text:string>>")
        kept = spark.read.parquet(str(tmp_path / f"v{v}")).dropDuplicates(["doc_id"]).join(edits, "doc_id", "left")
        new = apply_edits(kept, PATH)
        new.select("doc_id", F.col("n_tokens_edited").alias("n_tokens"), "leaves").write.parquet(str(tmp_path / f"v{v + 1}"))
        texts = {i: after(t, some.get(i)) for i, t in texts.items()}
        found = {x.doc_id: (x.n_tokens, "".join(n.text for n in x.leaves)) for x in spark.read.parquet(str(tmp_path / f"v{v + 1}")).collect()}
        assert found == {i: (size(t), t) for i, t in texts.items()}
