import hashlib

from quarry.llm import chat, queries


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def test_query_matches_brute_force(spark, tmp_path):
    odd = ["", None, "a</turn>\n<turn:user>b", "&lt; & &amp; <image:1>", "é😀\n\n", "x" * 50_000, "\\### Assistant: </turn> ok"]
    rows = [(c, t, ["user", "assistant", "system", "<r&>"][(c + t) % 4], odd[(c * 3 + t) % len(odd)], 0) for c in range(9) for t in range(1 + c)]
    rows += [(3, 1, "user", "tie", 0), (3, 1, "user", "tie", 0), (None, 0, "user", "z", 0), (4, None, None, "first", 0)]
    rows += [(50, t, "assistant" if t % 2 else "user", f"t{t}", 0) for t in range(2000)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, start int").write.parquet(f"{tmp_path}/conversations.parquet")
    said = "\\### Assistant: </turn> ok"
    rows += [(-7, 0, "user", said, 0), (-7, 1, "assistant", said, 0)]
    found = queries.op7_chat_format(spark, str(tmp_path)).collect()
    assert len(found) == len({r[0] for r in rows})
    for r in found:
        own = sorted(((-1 if t is None else t), ro or "", x or "") for c, t, ro, x, _ in rows if c == r.conv_id)
        learnt = "".join(x for _, ro, x in own if ro == "assistant")
        esc = lambda x: x.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
        assert (r.n_turns, r.turns_sha256) == (len(own), sha("".join(f"{ro}\n{x}\n" for _, ro, x in own)))
        assert (r.loss_chars, r.loss_sha256) == (len(learnt), sha(learnt))
        assert r.formatted_chars == sum(len(f"<turn:{esc(ro)}>{esc(x)}</turn>\n") for _, ro, x in own)


def test_parts_become_numbered_placeholders(spark):
    parts = [("text", "see <this> ", None, None), ("image", None, "s3://a.png", 2), ("audio", None, "b.wav", 30), ("text", " and ", None, None), ("odd", None, None, None)]
    rows = [(1, 0, "user", parts), (1, 1, "assistant", [("image", None, "c.png", 1), ("text", None, None, None)]), (1, 2, "user", None)]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {chat.PARTS}")
    (r,) = chat.formatted(chat.visited(df)).collect()
    assert r.formatted == "<turn:user>see &lt;this&gt; <image:1><audio:2> and <document:3></turn>\n<turn:assistant><image:4></turn>\n<turn:user></turn>\n"
    assert [tuple(a) for a in r.attachments] == [(1, "image", "s3://a.png", 512), (2, "audio", "b.wav", 750), (3, "document", None, 512), (4, "image", "c.png", 256)]
    assert r.n_expanded == 2030
    assert [r.formatted[s.start : s.end] for s in r.loss] == ["<image:4>"]


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert [r.conv_id for r in queries.op7_chat_format(spark, str(tmp_path)).collect()] == [-7]


def test_native_plan(spark, tmp_path):
    spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    plan = queries.op7_chat_format(spark, str(tmp_path))._jdf.queryExecution().toString()
    assert "Python" not in plan and plan.split("== Physical Plan ==")[1].count("Exchange hashpartitioning") == 1


def test_tied_turns_go_by_text_as_the_sql_says(spark, tmp_path):
    import duckdb

    texts = ['a"b', "a#b", "a!b", "a\\b", "a\nb", "a", "", None, '"', "#", "é", "z"]
    rows = [(1, 0, "user", t) for t in texts] + [(1, 0, "assistant", t) for t in texts]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    said = duck.execute(queries.OP7_SQL)
    names = [x[0] for x in said.description]
    want = sorted(tuple(r[names.index(c)] for c in sorted(names)) for r in said.fetchall())
    assert sorted(tuple(r[c] for c in sorted(names)) for r in queries.op7_chat_format(spark, str(tmp_path)).collect()) == want
