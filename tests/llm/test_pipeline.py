"""The pipeline's rows against a plain version of every stage: DuckDB for what SQL has, pairs by brute force
for the near-dedup, and the public library for the tokens."""

import collections
import random

import duckdb
import pandas as pd
import sentencepiece
from test_near_dedup import edited, kept

import corpus_pipeline
from netledger.llm import mixing, quality_rules, secrets, sentencepiece_codec

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def asked(rows, sql):
    con = duckdb.connect()
    con.register("frame", pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source", "n_chars"]))
    con.sql("CREATE TABLE documents AS SELECT doc_id::BIGINT AS doc_id, text::VARCHAR AS text, lang::VARCHAR AS lang, source::VARCHAR AS source, n_chars::BIGINT AS n_chars FROM frame")
    return con.sql(sql).df().to_dict("records")


def redacted(text, spans):
    out, at = "", 0
    for start, end in sorted(tuple(map(int, s.split(":")[1:])) for s in spans.split(",") if s):
        if start >= at:
            out += text[at:start] + "[SECRET]"
        at = max(at, end)
    return out + text[at:]


def plain_pipeline(rows):
    """Rows that have different ids, by the definitions of the stages."""
    good = {r["doc_id"] for r in asked(rows, quality_rules.SQL) if r["kept"]}
    rows = sorted(r for r in rows if r[0] in good)
    stay = kept([r[1] for r in rows])
    rows = [r for i, r in enumerate(rows) if i in stay]
    spans = {r["doc_id"]: r["spans"] for r in asked(rows, secrets.SQL)}
    rows = [(i, redacted(t, spans[i]), lang, source, n) for i, t, lang, source, n in rows]
    taken = {r["doc_id"]: r["taken"] for r in asked(rows, mixing.SQL)}
    library = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.MODEL)
    out = []
    for i, text, lang, source, _ in rows:
        words = text.split()
        whole, rest = divmod(int(taken[i]), len(words))
        for copy in [text] * whole + [" ".join(words[:rest])] * bool(rest):
            ids = library.encode(copy)
            out.append((i, lang, source, len(ids), tuple(ids)))
    return out


def corpus():
    rng = random.Random(21)
    vocabulary = [f"{a}{b}{c}" for a in "bdgklm" for b in "aeiou" for c in ("n", "r", "st", "l")]
    words = lambda n: [rng.choice(["the", "of", "and"]) if rng.random() < 0.3 else rng.choice(vocabulary) for _ in range(n)]
    rows = []
    for i in range(90):
        w = words(rng.randint(25, 130))
        if i % 6 == 0:
            w.insert(rng.randrange(len(w)), f"login=user{i} {'aB3' * 9}")
        if i % 7 == 0:
            w.insert(rng.randrange(len(w)), f'token = "{rng.getrandbits(160):040x}"')
        rows.append([i, " ".join(w), "en", f"s{i % 7}", 0])
        if i % 5 == 0:
            rows.append([1000 + i, " ".join(edited(rng, w, 1)) if len(w) > 60 else " ".join(w), "en", f"s{(i + 1) % 7}", 0])
    rows += [[2000, "short", "en", "s0", 0], [2001, None, "en", "s0", 0], [2002, "", "en", "s0", 0], [2003, "### $$$ " * 40, "en", "s0", 0], [2004, " ".join(words(9) * 12), "en", "s0", 0], [2005, rows[0][1].upper(), None, None, None]]
    rows += [[2006, "é\n\n" + " ".join(words(3000)) + "\n日本語 😀", "fr", None, 9]]
    return [tuple(r) for r in rows]


def test_the_pipeline_equals_its_plain_version(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = [(r.doc_id, r.lang, r.source, r.n_tokens, tuple(r.ids)) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    want = plain_pipeline(rows)
    assert 60 < len({r[0] for r in want}) < len(rows) and collections.Counter(map(repr, got)) == collections.Counter(map(repr, want))


def test_awkward_rows_pass_all_stages(spark):
    rows = corpus()[:30]
    rows += [(None, rows[1][1], None, None, None), rows[0], rows[0], (None, None, None, None, None), (3000, "word " * 20_000 + "the of and", "en", "s1", 1), (rows[2][0], rows[3][1], "en", "s0", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        left = {(r.doc_id, r.text) for r in docs.collect()}
        assert left
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() == docs.count()
