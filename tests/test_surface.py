import pytest

from prosemill import cli
from prosemill.functions.register import register
from prosemill.plans import drift, engine
from prosemill.rules.loader import load, load_text
from prosemill.sources import from_table


def test_sql_functions(spark):
    register(spark, load())
    row = spark.sql("select word_count('a - b') n, sentences_of('One. Two!') s, mask_markdown('`x` y') m, lcs_ratio('a b c', 'a c') r, word_count(cast(null as string)) z").first()
    assert (row.n, list(row.s), row.m, row.r, row.z) == (2, ["One.", "Two!"], "`\0\0 y", 1.0, None)
    found = spark.sql("select f.rule_id from values ('We utilize it') t(x), lateral scan_findings(x) f").collect()
    assert [r.rule_id for r in found] == ["STARTER-VOCAB#utilize"]


def test_drift(spark, tmp_path):
    docs = spark.createDataFrame([(1, "We utilize it. lorem ipsum")], "id int, text string")
    found = engine.scan(from_table(docs, "id"), load())
    path = str(tmp_path / "log")
    drift.append(drift.entry(found, "a", "2026-01-01"), path)
    drift.append(drift.entry(found.where("tier > 1"), "b", "2026-01-02"), path)
    log = spark.read.option("header", "true").csv(path)
    rows = drift.changes(log).orderBy("timestamp").collect()
    assert [(r.d_tier1, r.d_tier2, r.d_tier3) for r in rows] == [(None, None, None), (-1, 0, 0)]


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.chdir(tmp_path)
    (tmp_path / "a.md").write_text("We utilize it in order to win.")
    assert cli.main(["init"]) == 0 and cli.main(["init"]) == 2 and cli.main(["plugins"]) == 0
    assert cli.main(["lint", str(tmp_path / "a.md"), "--format", "json"]) == 1
    assert '"rule_id":"STARTER-VOCAB#utilize"' in capsys.readouterr().out
    assert cli.main(["lint", str(tmp_path / "a.md"), "--format", "github"]) == 1 and cli.main(["lint", str(tmp_path / "a.md")]) == 1
    assert cli.main(["fix", str(tmp_path / "a.md"), "--out", str(tmp_path / "out")]) == 1
    assert spark.read.parquet(str(tmp_path / "out")).first().fixed == "We utilize it to win."
    (tmp_path / "bad.toml").write_text("[[group]]\n")
    assert cli.main(["--rule-file", "bad.toml", "rules"]) == 2 and cli.main(["rules", "--json"]) == 0
    (tmp_path / ".prosemill.toml").write_text("[odd]\n")
    assert cli.main(["rules"]) == 2


def test_runs_are_the_same_twice(spark):
    docs = from_table(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), "doc_id")
    pack = '[[group]]\nid-base = "A"\nkind = "vocab"\ntier = 2\ncategory = "c"\n[[group.entries]]\nslug = "t"\nterms = ["the of", "that"]\n'
    one, two = (engine.ordered(engine.scan(docs, load_text([("p", pack)]))).collect() for _ in range(2))
    assert one == two and one


def test_plugins_are_stopped_and_checked():
    from prosemill import plugins as P

    envelope = P.Envelope("some Text, text.", [], [], [], {})
    endless = P.Plugin("E", 2, "c", lambda _: [x for x in iter(int, 1)], seconds=0.2)
    large = P.Plugin("L", 2, "c", lambda _: [bytearray(30_000_000)] and [], memory_mb=16)
    for plugin, why in ((endless, "time"), (large, "memory"), (P.scripted("F", fails=KeyError("x")), "KeyError")):
        with pytest.raises(P.PluginError, match=why):
            plugin.call(envelope)
    assert P.scripted("S", [("a", 0, 1, "m", None)]).call(envelope) == [("a", 0, 1, "m", None)]
    assert P.find_all_words("Text context text_ tExt", "text") == [(0, 4), (19, 23)] and P.find_word("none", "text") is None
    made = P.plugin("MADE", 2, "c", share=0.5, on=True)(lambda e: [])
    assert made.mistyped({"share": 1, "on": True}) == [] and len(made.mistyped({"share": "1", "on": 1})) == 2
    used, warnings = P.loaded({"EXCLAIM": {"runtime": {"seconds": 3.0}}, "MADE": {"share": "much"}, "OTHER": {}}, {"MADE": made})
    assert [p.id for p, _ in used] == ["EXCLAIM"] and used[0][0].seconds == 3.0 and len(warnings) == 2
    assert P.loaded({"KEY": {}}, {"KEY": made})[1] == ["plugin 'KEY' calls itself 'MADE'"]


def test_windows_of_lines():
    from prosemill.plans.truncate import clusters, window

    assert window("a line", 2, 6, 0) == ("a line", 2, 4)
    line = "x" * 50 + "中文" + "y" * 50
    shown, before, size = window(line, 50, 52, 30)
    assert "中文" in shown and shown[0] == shown[-1] == "…" and size == 4 and len(shown) + 2 <= 30 and shown[: before].count("x") == before - 1
    assert window("\tab", 1, 2, 0) == ("    ab", 4, 1) and clusters("é👩‍🔬") == ["é", "👩‍🔬"]
    assert window("", 0, 0, 20) == ("", 0, 1)


def test_human_report_marks_every_line():
    from types import SimpleNamespace

    from prosemill.plans import render
    from prosemill.rules.model import LoadError

    row = SimpleNamespace(tier=2, rule_id="R#a", message="m", start=4, end=15, path="p", line=1, col=5, excerpt="two\nthree f", anchorless=False, advice="do", context=None, url=None)
    got = render.human([row], {"p": "one two\nthree four\n"})
    assert got.split("\n")[2:6] == ["    1 | one two", "      |     ^^^", "    2 | three four", "      | ^^^^^^^"]
    told = render.load_errors([LoadError("a.toml", "x", 9), LoadError("b.toml", "z"), LoadError("a.toml", "y", 2)])
    assert told.split("\n") == ["error: a.toml: 2 problems", "  line 2: y", "  line 9: x", "error: b.toml: 1 problem", "  z"]


def test_models(tmp_path):
    import hashlib

    import numpy as np

    from prosemill import embedder as E

    (tmp_path / "w").write_bytes(b"weights")
    files = E.ModelFiles(tmp_path, {"w": hashlib.sha256(b"weights").hexdigest(), "t": None})
    assert [len(x) for x in files.problems()] == [1, 0]
    assert [len(x) for x in E.ModelFiles(tmp_path, {"w": "00"}).problems()] == [0, 1]
    states = np.array([[[1.0, 0.0], [0.0, 1.0], [9.0, 9.0]], [[0.0, 2.0], [5.0, 5.0], [5.0, 5.0]]], np.float32)
    assert np.allclose(E.pooled(states, np.array([[1, 1, 0], [1, 0, 0]])), [[0.5**0.5, 0.5**0.5], [0, 1]])
    sizes = []
    model = E.Model(lambda ts: sizes.append(len(ts)) or E.padded([[len(t)] * len(t) for t in ts], 5), lambda ids, mask: np.stack([ids, ids * 0 + 1], 2).astype(np.float32))
    out = model(["a" * (k % 7 + 1) for k in range(40)])
    assert out.shape == (40, 2) and np.allclose(np.linalg.norm(out, axis=1), 1) and sizes == [16, 16, 8] and model([]).shape[0] == 0
    assert E.double({"a": [1.0, 0.0]}, 2)(["a", "b"]).tolist() == [[1.0, 0.0], [0.0, 0.0]]


def test_pack_roots(tmp_path, monkeypatch):
    from prosemill import config as C

    (tmp_path / "mine.toml").write_text("")
    assert C.pack_root(tmp_path) == tmp_path and C.builtin_pack("mine", tmp_path) == tmp_path / "mine.toml"
    assert C.builtin_pack("starter", None).exists()
    with pytest.raises(C.ConfigError):
        C.builtin_pack("none", None)
    monkeypatch.chdir(tmp_path)
    monkeypatch.setenv("HOME", str(tmp_path))
    assert C.pack_root() is None
    (tmp_path / "rules").mkdir()
    assert C.pack_root() is not None


@pytest.mark.parametrize("text", ["", "a _b_ __ -- c- -d, é_", "**x** ... !? 12 z   ___1", "“—” — ’s"])
def test_word_counts(text):
    from prosemill.functions.words import word_count

    assert word_count(text) == sum(any(c.isalnum() for c in w) for w in text.split())


def test_extra_globs(spark, tmp_path):
    from prosemill.sources import from_files

    for name in ("a.md", "b.log", "c.note", "d.bin"):
        (tmp_path / name).write_text(name)
    got = {r.text for r in from_files(spark, str(tmp_path), globs=["*.log", "c.*"]).collect()}
    assert got == {"a.md", "b.log", "c.note"} and {r.text for r in from_files(spark, str(tmp_path)).collect()} == {"a.md"}
