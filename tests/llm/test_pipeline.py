import hashlib
import random

import pytest

pytest.importorskip("corpus_pipeline")


def test_pipeline_equals_plain_version(spark, tmp_path):
    """Planted documents against a plain version: language by vocabulary, all pairs of shingle sets, items by search."""
    from tokenizers import Tokenizer

    import corpus_pipeline
    from cloakframe.llm.queries import vocabulary
    from tests.llm.test_llm import shingles

    rng = random.Random(8)
    speech = {"en": "the thing and with ought where weather shown winter what when", "de": "der schön nicht zwei über für straße gemäß würde jahr größe"}
    vocab = {k: [a + b for a in v.split() for b in v.split()] for k, v in speech.items()}
    say = lambda lang, n: " ".join(rng.choice(vocab[lang]) for _ in range(n))
    items = [say("en", n) for n in (15, 30, 60)]
    key = "0641917ea4e9feb9cda83477b57ac2654884f485"
    rows = [(i, say(lang, 60), lang) for i in range(60) for lang in [("en", "de")[i % 2]]]
    rows += [(100 + i, rows[i][1], rows[i][2]) for i in range(8)]  # exact copies
    rows += [(110 + i, rows[20][1] + " " + say("en", 1 + i % 3), "en") for i in range(12)]  # near copies
    rows += [(130 + i, f"{say('en', 20)} {items[i % 3]} {say('en', 20)}", "en") for i in range(6)]
    rows += [(140 + i, f'{say("en", 30)} token = "{key[i:]}{key[:i]}" {say("en", 30)}', "en") for i in range(4)]
    rows += [(150, None, "en"), (151, "", None), (152, "12 %% 34", "de"), (153, say("de", 2), None)]
    rng.shuffle(rows)
    spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    said = {i: t for i, t, _ in rows if any(c.isalpha() for c in t or "")}
    sets = {i: shingles(t) for i, t in said.items()}
    group = {i: i for i in said}
    for _ in said:  # the smallest id travels along links until nothing changes
        before = dict(group)
        for a in sets:
            for b in sets:
                if a != b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    group[a] = min(group[a], group[b])
        if group == before:
            break
    kept = {i: said[i] for i in said if group[i] == i and not any(x in said[i] for x in items)}
    lib, want = Tokenizer.from_file(vocabulary("byte_bpe_50k.json")), {}
    for i, t in kept.items():
        for k in range(4):
            t = t.replace(key[k:] + key[:k], "[SECRET]")
        ids = lib.encode(t, add_special_tokens=False).ids
        want[i] = (ids, hashlib.sha256(t.encode()).hexdigest())

    got = {r.doc_id: (list(r.ids), r.decoded_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == want
    assert not set(want) & {100, 110, 121, 130, 135, 150, 151, 152} and {0, 20, 59, 140, 143, 153} <= set(want)


def test_stages_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_rows_with_shared_null_and_clashing_ids(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(5)
    say = lambda n: " ".join(rng.choice(["the", "thing", "with", "ought", "where", "weather", "shown"]) + rng.choice("abcdefgh") for _ in range(n))
    a, b, c, d, item = (say(60) for _ in range(5))
    rows = [(1, a, "x"), (1, b, "x"), (None, c, "x"), (None, a + " more", "x"), (2, c, "y"), (3, d, "x"), (3, d, "x"), (None, f"{say(20)} {item} {say(20)}", "x"), (4, f"{say(20)} {item}", "x"), (4, say(50), "x")]
    schema = "doc_id long, text string, source string, component_id int, lang string"
    docs = spark.createDataFrame([(*r, 7, "en") for r in rows], schema).cache()
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    key = lambda df: sorted((str(r.doc_id), r.text, r.source) for r in df.collect())
    got = corpus_pipeline.deduplicated(spark, docs, str(tmp_path))
    assert got.columns == docs.columns and key(got) == sorted((str(i), t, s) for i, t, s in [rows[0], rows[1], rows[4], rows[5], *rows[7:]])
    got = corpus_pipeline.decontaminated(spark, docs, str(tmp_path))
    assert got.columns == docs.columns and key(got) == sorted((str(i), t, s) for i, t, s in [*rows[:7], rows[9]])
    assert key(corpus_pipeline.without_secrets(spark, docs, "")) == key(docs) and corpus_pipeline.identified(spark, docs, "").columns == docs.columns
    assert corpus_pipeline.encoded(spark, docs, "").count() == len(rows)


def test_nulls_in_different_columns_are_different_rows(spark):
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, " ", "en", None, 1), (1, " ", None, "en", 1), (1, " ", None, "en", 1), (2, "a b c d e f g h " * 4000, None, None, None), (3, "a b c d e f g h " * 4000, None, None, None)]
    kept = corpus_pipeline.deduplicated(spark, spark.createDataFrame(rows, schema), "")
    assert sorted((r.doc_id, r.lang or "", r.source or "") for r in kept.collect()) == [(1, "", "en"), (1, "en", ""), (2, "", "")]
