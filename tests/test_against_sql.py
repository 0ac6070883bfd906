"""Registered queries on small odd tables against their SQL."""

import duckdb

import __spark_entry__ as entry

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def agree(spark, folder, query, **tables):
    """Rows that only the query and only its SQL give."""
    db = duckdb.connect()
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet/*.parquet')")
    want = db.execute(entry.oracle_sql()[query]).fetchall()
    columns = [d[0] for d in db.description]
    got = [tuple(r) for r in entry.queries()[query](spark, str(folder)).select(columns).collect()]
    return [r for r in got if r not in want], [r for r in want if r not in got], len(got) - len(want)


def documents(texts):
    return [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], DOCUMENTS


def test_chunk_languages_keeps_short_last_pieces(spark, tmp_path):
    """runs of 201 and 401 lines and a few more, of which the last piece is a line or two, and short runs."""
    texts = ["\n".join(["word"] * n) for n in (199, 200, 399, 1, 3, 4, 198, 201)] * 5
    assert agree(spark, tmp_path, "chunk_languages", documents=documents(texts)) == ([], [], 0)


def test_complexity_score_by_exact_hundredths_and_ascii_words(spark, tmp_path):
    """sums of factors that are not exact in binary, words beside letters beyond ASCII, odd ends of lines."""
    said = [
        "a short question about nothing in particular, if or when", "maybe or possibly or something, when", "éset", "mapß and größer or säwhen", "set", "oré or", "üimport", "two words\rset", "two words set it", "x\x0b", " x \nthe rest of it",
        "a b\nword \n", "```", "api class query", "api or class or query if maybe", "what is a file? or a line? why", "see a/b.ts, c.py and d.rs from x", "async set sort try test factory ?? \nok", "y" * 330 + " or if", "", None,
    ]
    rows = [(i, 0, "user", t) for i, t in enumerate(said)] + [(100 + n, 0, "user", "something or if " + "word " * n) for n in range(0, 110)]
    assert agree(spark, tmp_path, "complexity_score", conversations=(rows, "conv_id long, turn int, role string, text string")) == ([], [], 0)


def test_token_breakdown_by_ascii_words(spark, tmp_path):
    """F2, the same edges of words: keywords and addresses beside letters beyond ASCII."""
    texts = ["ñlet x = {a} == class y", "éa@b.co and ü.b@c.de", "let x = 1; constß y == 2 { }", "a@b.coé and x@y.org"]
    assert agree(spark, tmp_path, "token_breakdown", documents=documents(texts)) == ([], [], 0)
