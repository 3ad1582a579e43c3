from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.functions.blocks import chunks, parse_blocks, register, split_long, windows
from quarry.functions.tables import grid_latex, grid_markdown, grid_of, padded


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("x")).first().x


def test_markdown_is_cleaned(spark):
    page = "# Title\nAnn Bee\nann@x.org and others here\nSchool of Things at Place\nA kept long line here\n## Abstract\nBody text.\n<div class=a>junk\nmore</div>\n![i](a.png)\nTable 2: a caption\ncode: here\nsee github.com/x\nlast line\n# References\n[1] x"
    assert one(spark, page, T.markdown_text) == "# Title\nA kept long line here\n## Abstract\nBody text.\n \n \n \nlast line"


def test_small_text_functions(spark):
    assert one(spark, "One two. Three four! 中文。 end", T.sentences) == ["One two.", "Three four!", "中文。", "end"]
    assert one(spark, "- we propose  it", T.as_claim) == "We propose it."
    assert one(spark, "a b\n\n \n\nc\n\nd", lambda c: T.paragraph_range(T.paragraphs(c), F.array(F.lit("P1"), F.lit("P2"), F.lit("x")))) == "a b\n\nc"
    assert one(spark, "These models Learn learn graphs with graph-like forms", T.key_terms) == ["models", "Learn", "graphs", "graph-like", "forms"]
    assert one(spark, "x" * 30, lambda c: T.compact(c, 10)) == "x" * 7 + "..." and one(spark, None, lambda c: T.compact(c, 5)) == ""
    assert one(spark, " =1+1", T.csv_guarded) == "' =1+1" and one(spark, "a=1", T.csv_guarded) == "a=1"
    assert [one(spark, x, T.safe_id) for x in ("T 1/é!", "", None, "__")] == ["T_1", "NA", "NA", "NA"]
    assert [one(spark, x, T.confidence) for x in ("0.55555", "7", "x", None)] == [0.5556, 1.0, 0.0, 0.0]
    assert tuple(one(spark, "Fig. 3: x", T.caption)) == ("figure", "3") and one(spark, "none", T.caption) is None
    assert one(spark, "<img class=x src='a b.png'>", T.image_path) == "a b.png" and one(spark, "![x](y.png \"t\")", T.image_path) == "y.png" and one(spark, "z", T.image_path) is None
    assert one(spark, "(a) one (B) two (a)", T.panel_labels) == ["a", "b"] and one(spark, "is KC12 so", T.leaks_labels)
    assert one(spark, "{b}", lambda c: T.rendered("<{a}|{b}>", a=c, b=F.lit("B"))) == "<{b}|B>"
    assert one(spark, "we show results because 3", T.sentence_score) == 7
    assert one(spark, " a, b a\tc,", T.id_list) == ["a", "b", "c"]
    assert one(spark, "m", lambda c: T.merged_scope(F.create_map(F.lit("k"), F.lit(" "), F.lit("z"), c), {"k": "d"})) == {"k": "d", "z": "m"}
    assert one(spark, None, lambda c: T.signature(c, F.lit(""))) != one(spark, "", lambda c: T.signature(c, F.lit("")))
    assert one(spark, "<p>a &lt;b&gt;&amp;lt;<script>x</script> c</p>", T.html_text) == "a <b>&lt; c"


def test_grids(spark):
    assert grid_of("<table><tr><td rowspan=2>a</td><td>b</td></tr><tr><td>c</td></tr></table>") == [["a", "b"], ["a", "c"]]
    assert grid_of("<tr><th colspan=2>h &amp; k</th></tr><tr><td>1</td></tr>") == [["h & k", "h & k"], ["1", ""]]
    assert grid_of("<table><tr><td rowspan=2 colspan=2>x</td><td>y</td></tr><tr><td>z</td></tr><tr><td>w<td>v</table>") == [["x", "x", "y"], ["x", "x", "z"], ["w", "v", ""]]
    assert grid_of("<tr><td rowspan=5000>a</td></tr>" + "<tr><td>b</td></tr>" * 3000) == [["a", ""]] + [["a", "b"]] * 3000
    assert grid_of("<tr><td rowspan=99999999999999999999>a</td><td rowspan=²>b</td></tr><tr></tr>") == [["a", "b"], ["a", ""]]
    assert grid_of("") == [] and grid_of(None) == []
    df = spark.createDataFrame([([["a|b", "50%"], ["x_y", "\\"]],), ([],), ([["a"], []],)], "g array<array<string>>")
    rows = df.select(grid_markdown(F.col("g")).alias("m"), grid_latex(F.col("g")).alias("l"), padded(F.col("g")).alias("p")).collect()
    assert rows[0].m == "| a\\|b | 50% |\n| --- | --- |\n| x_y | \\ |" and rows[1].m == "" and rows[1].l == ""
    assert rows[0].l == "\\begin{tabular}{ll}\na|b & 50\\% \\\\\nx\\_y & \\textbackslash{} \\\\\n\\end{tabular}"
    assert rows[2].p == [["a"], [""]]


def test_blocks_and_chunks(spark):
    page = "# T\npara one\nline\n\n<table><tr><td>Table 1</td></tr></table>\n<div>\n<img src='i.png'>\nFigure 2\n</div>\n![a](b.png)\nFig. 3 cap"
    kinds = [(b[1], b[3], b[4], b[5]) for b in parse_blocks(page)]
    assert kinds == [("heading", None, None, None), ("paragraph", None, None, None), ("table", None, "table", "1"), ("html", "i.png", "figure", "2"), ("image", "b.png", None, None), ("caption", None, "figure", "3")]
    text = " ".join(f"Sentence number {i} ends here." for i in range(200))
    parts = list(chunks(text, 500, 60))
    assert max(map(len, parts)) <= 500 and all(p.endswith(".") for p in parts) and "".join(parts[0])[:10] == text[:10] and parts[-1].endswith(text[-20:])
    assert list(chunks("", 10, 2)) == [] and list(chunks(None, 10, 2)) == []
    assert "".join(split_long("x" * 95, 40)) == "x" * 95
    paras = "\n\n".join(f"paragraph {i} " + "y" * 50 for i in range(30))
    packed = list(windows(paras, 300, 1))
    assert max(map(len, packed)) <= 300 and all(f"paragraph {i} " in "\n".join(packed) for i in range(30)) and packed[1].split("\n\n")[0] == packed[0].split("\n\n")[-1]
    register(spark)
    assert spark.sql("SELECT count(*) AS n FROM text_chunks('a b c', 3, 1)").first().n >= 1
    assert [r.kind for r in spark.sql("SELECT * FROM md_blocks('# a\n\nb')").collect()] == ["heading", "paragraph"]


def test_claims_and_sections(spark):
    from quarry.functions import claims as C

    rows = [("We propose a new module", "3 Method", "method"), ("nothing here", "", ""), ("accuracy table figure", "Results", "result"), ("the gap is an issue", "Introduction", "motivation"), ("existing dataset checked", "Video Fact-Checking Datasets", "resource")]
    got = spark.createDataFrame(rows, "c string, s string, r string").select(C.macro_of(F.col("c"), F.col("s")), C.claim_type(F.col("c"), F.col("r"))).collect()
    assert [tuple(r) for r in got] == [("M2", "mechanism"), ("M2", "conclusion"), ("M3", "result"), ("M1", "problem"), ("M1", "dataset")]
    text = "opening words\n# Page 2\nstill opening\n## Abstract\nshort\n## Small\ntiny\n## Long\n" + "y" * 200 + "\n### Acknowledgements\nthanks"
    found = C.sections(spark.createDataFrame([(1, text), (2, "plain")], "i int, t string"), "i", "t").orderBy("i", "section_id").collect()
    assert [(r.i, r.section_id, r.title, r.text[:40]) for r in found] == [(1, "S1", "Preamble", "opening words\nstill opening"), (1, "S2", "Abstract", "short\n\ntiny"), (1, "S3", "Long", "y" * 40), (2, "S1", "Preamble", "plain")]


def test_a_paper_is_read_once_however_many_lines(spark):
    """Where the body opens is looked for once a text, not once a line, and what a value goes into does not make it again."""
    names = [f"author {i} of a long line" if i % 3 else f"person {i} @home of a long line" for i in range(400)]
    body = ["## Abstract", "short", "someone @ home", "code: none", "the end"]
    df = spark.createDataFrame([(1, "\n".join(["# A title", *names, *body])), (2, "\n".join(body)), (3, "# A title\nsome words\nx y"), (4, ""), (5, None)], "k int, t string")
    got = df.select("k", T.bound(T.markdown_text(F.col("t")), lambda t: F.struct(t.alias("t"), F.char_length(t).alias("n"))).alias("of")).select("k", "of.t", "of.n")
    kept = ["## Abstract", "short", "someone @ home", "the end"]
    assert {r.k: r.t for r in got.collect()} == {1: "\n".join(["# A title", *(x for x in names if "@" not in x), *kept]), 2: "\n".join(kept), 3: "# A title\nsome words\nx y", 4: "", 5: None}
    said = got._jdf.queryExecution().optimizedPlan().toString()
    assert said.count("^## abstract") == 1 and said.count("<div[^>]*>") == 1
