import json

import pytest

from prosemill.config import ConfigError, discover, parse
from prosemill.operators.rewrite import fix
from prosemill.operators.scan import Scanner
from prosemill.plans import engine, render
from prosemill.plugins import BUILTIN, Envelope, Plugin, PluginError, loaded
from prosemill.rules.loader import load_text
from prosemill.rules.model import Settings

PACK = """
[[group]]
id-base = "V"
kind = "vocab"
tier = 2
category = "c"
advice = "not {match}"
[[group.entries]]
slug = "phrase"
terms = ["a testament to"]
[[group.entries]]
slug = "word"
terms = ["testament"]
[[group.entries]]
slug = "use"
terms = ["utilize"]
replacement = "use"
[[group.entries]]
slug = "drop"
terms = ["basically"]
replacement = ""

[[group]]
id-base = "L"
kind = "literal-ban"
tier = 1
category = "c"
[[group.entries]]
slug = "ref"
terms = ["ref[oaicite:{N}]", "[oaicite:{N}]"]

[[group]]
id-base = "P"
kind = "pattern"
tier = 2
category = "c"
[[group.entries]]
slug = "not"
regex = '\\bnot (?P<payload>\\w+) but\\b'
message = "payload {payload}"

[[group]]
id-base = "C"
kind = "metric"
tier = 3
category = "c"
stat = "term_cluster_max"
window = "paragraph"
threshold-gt = 1
terms = ["alpha", "beta"]

[[group]]
id-base = "R"
kind = "repetition"
tier = 3
category = "c"
variant = "near-verbatim"
threshold = 0.6
max-distance = 20
"""
RULES = load_text([("p", PACK)])


def ids(text, settings=None, **kw):
    return [f.rule_id for f in Scanner(RULES, settings, **kw).scan(text)[0]]


def test_phrases_and_nested_words_fire():
    assert ids("It is a testament to care.") == ["V#phrase", "V#word"]
    assert ids("a  testament to") == ["V#word"]


def test_literals_overlap_and_are_masked():
    found = Scanner(RULES).scan("x ref[oaicite:16] `ref[oaicite:1]`")[0]
    assert [(f.start, f.end) for f in found] == [(2, 17), (5, 17)]


def test_pattern_captures_and_code():
    found = Scanner(RULES).scan("It is not luck but work. not `x` but")[0]
    assert [(f.message, f.excerpt) for f in found] == [("payload luck", "not luck but")]


def test_mentions_are_silent():
    assert ids('The word "utilize" is odd.') == [] and ids("We utilize it.") == ["V#use"]


def test_spans_are_bytes_of_the_original():
    text = "é\r\n\r\nWe utilize — it"
    f = Scanner(RULES).scan(text)[0][0]
    assert text.encode()[f.start : f.end] == b"utilize" and (f.line, f.col) == (3, 4)


def test_cluster_and_repetition():
    found = Scanner(RULES).scan("Alpha and beta here.\r\n\r\nnothing")[0]
    assert [(f.rule_id, f.context) for f in found] == [("C", "Clustered terms:\n  alpha\n  beta")] and found[0].anchorless
    s = "The quick brown fox jumps over the lazy dog. "
    near = Scanner(RULES).scan(s + s)[0]
    assert near[0].rule_id == "R" and near[0].context.count("line 1") == 2
    assert not ids(s + "Some other words stand here in between the two so that they are far. And even more of them follow here today ok. " + s)


def test_levels_and_tiers():
    assert ids("utilize [oaicite:1]", Settings({"v": "allow"})) == ["L#ref"]
    assert ids("utilize [oaicite:1]", Settings({"v": "allow", "v#use": "warn"})) == ["V#use", "L#ref"]
    assert ids("utilize [oaicite:1]", Settings(max_tier=1)) == ["V#use", "L#ref"]
    assert Scanner(RULES, Settings({"v#use": "error"})).scan("utilize")[0][0].tier == 1


def test_fix():
    def done(t):
        return fix(t, Scanner(RULES).scan(t)[0])

    assert done("We utilize it.\r\nIt is basically done.").text == "We use it.\r\nIt is done."
    assert done(done("We utilize basically it").text).applied == 0
    overlap = done("It is not utilize but")
    assert overlap.text == "It is not utilize but" and overlap.overlapped == 1 and overlap.unfixable == 1


def test_plugins():
    text = "wow! " * 300
    assert [f.rule_id for f in Scanner(load_text([]), plugins=loaded({"exclaim": {}})[0]).scan(text)[0]] == ["EXCLAIM#rate"]
    many = Plugin("MANY", 3, "c", lambda e: [("s", 0, 0, "m", None)] * 1001)
    with pytest.raises(PluginError):
        many.call(Envelope("", [], [], [], {}))
    broken = Plugin("BAD", 3, "c", lambda e: 1 / 0)
    odd = Plugin("ODD", 3, "c", lambda e: [("a", 0, 1, "m", None), ("a", 1, 2, "n", None), ("b", 5, 99, "o", None)])
    found, warned = Scanner(load_text([]), plugins=[(broken, {}), (odd, {})]).scan("abc")
    assert [f.message for f in found] == ["m"] and len(warned) == 2
    assert loaded({"nope": {}})[1] and Plugin("a b", 4, "c", lambda e: [], abi=2).problems()


def test_embedder():
    rules = load_text([("p", '[[group]]\nid-base = "M"\nkind = "repetition"\ntier = 2\ncategory = "c"\nvariant = "propositional"\nthreshold = 0.9\n')])
    text = "One two three four five six. Un deux trois quatre cinq six. Other things are said in here."
    same = Scanner(rules, embedder=lambda t: [[1.0, 0.0] if "three" in x or "trois" in x else [0.0, 1.0] for x in t]).scan(text)
    assert [f.rule_id for f in same[0]] == ["M"] and Scanner(rules).scan(text)[1]
    assert Scanner(rules, embedder=lambda t: []).scan(text)[1]


def test_config(tmp_path):
    c = parse('[lints]\nA = "warn"\n[scan]\ntiers = [1, 2]\n[plugin.X]\nwasm = "x"\nk = 1\n')
    assert c.settings().max_tier == 2 and c.settings().level("A") == "warn" and c.plugins["X"]["k"] == 1
    for bad in ('[lints]\nA = "loud"\n', "[odd]\n", "[scan]\nx = 1\n", '[output]\nformat = "xml"\n', "["):
        with pytest.raises(ConfigError):
            parse(bad)
    (tmp_path / ".prosemill.toml").write_text('[output]\nformat = "json"\n')
    (tmp_path / "a").mkdir()
    assert discover(tmp_path / "a").format == "json"


def test_engine(spark, tmp_path):
    docs = spark.createDataFrame([("b", "We utilize it.", 1), ("a", "[oaicite:1] a testament to", 2), ("n", None, 3)], "path string, text string, tier int")
    found = engine.scan(docs, RULES).cache()
    rows = engine.ordered(found).collect()
    assert [(r.path, r.rule_id) for r in rows] == [("a", "L#ref"), ("a", "V#phrase"), ("a", "V#word"), ("b", "V#use")]
    assert engine.blocking(found) and {r.tier: r.n for r in engine.tier_tally(found).collect()} == {1: 1, 2: 3}
    lines = [json.loads(r.json) for r in engine.ordered_lines(render.json_lines(found)).collect()]
    assert list(lines[3]) == ["rule_id", "kind", "tier", "category", "path", "span", "excerpt", "message", "replacement", "advice"] and lines[3]["replacement"] == "use" and lines[0]["replacement"] is None
    assert any(r.annotation.startswith("::error file=a,line=1,col=1,endLine=1,endColumn=12,title=L#ref::") for r in render.github_lines(found).collect())
    assert "V#use" in render.human(rows, {"b": "We utilize it."})
    fixed = {r.path: r for r in engine.fix(docs, RULES).collect()}
    assert fixed["b"].fixed == "We use it." and fixed["n"].fixed == ""
    total = engine.fix_summary(engine.fix(docs, RULES)).first()
    assert (total.applied, total.files_changed) == (1, 1)
    stats = {r.path: r.word_count for r in engine.doc_stats(docs).collect()}
    assert stats == {"a": 4, "b": 3, "n": 0}
    listing = engine.rule_listing(spark, RULES, Settings({"v": "allow"}), [(BUILTIN["EXCLAIM"], {})]).collect()
    assert {r.level for r in listing if r.id.startswith("V#")} == {"allow"} and listing[-1].kind == "plugin"


def test_empty_documents(spark):
    empty = spark.createDataFrame([], "path string, text string")
    assert engine.scan(empty, RULES).count() == 0 and engine.fix_summary(engine.fix(empty, RULES)).first().applied == 0


def test_stream_and_files(spark, tmp_path):
    from prosemill.sources import from_files
    from prosemill.streaming import scan_stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.md").write_text("We utilize it.")
    (tmp_path / "in/b.bin").write_text("We utilize it.")
    found = from_files(spark, str(tmp_path / "in"), str(tmp_path / "in/a.md"))
    assert [r.text for r in found.collect()] == ["We utilize it."]
    found.write.parquet(str(tmp_path / "table"))
    stream = spark.readStream.schema("path string, text string").parquet(str(tmp_path / "table"))
    q = scan_stream(stream, RULES).writeStream.format("memory").queryName("found").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [r.rule_id for r in spark.table("found").collect()] == ["V#use"]
