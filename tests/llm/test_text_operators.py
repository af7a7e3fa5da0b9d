import random
import re

import corpus_pipeline
import pytest

from prosemill.llm import decontamination as dec
from prosemill.llm import extraction as ext
from prosemill.llm.near_dedup import near_duplicates

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(
    "source, text",
    [
        ("", ""),
        ("<p>a <b>b</b>&amp; c<br>d</p><p>e", "a b& c d\n\ne"),
        ("<nav>menu</nav><header>site</header><p>x</p><footer>f</footer><aside>s</aside><form>q</form>", "x"),
        ("<article><header><h1>T</h1></header><p>x</p><div class='comments'>no</div></article>", "T\n\nx"),
        ('<script>var t="</p>"; x</script><style>p{}</style><!-- c --><p>ok</p>', "ok"),
        ("<p>one<p>two<ul><li>a<li>b</ul>", "one\n\ntwo\n\na\n\nb"),
        ("<div class='cookie-notice'>n</div><div class=\"post-body\">y &eacute;&#233;&nbsp;z</div>", "y éé z"),
        ("<p>a &lt; b</p><p title='x > y'>c</p>", "a < b\n\nc"),
        ("plain text\n only", "plain text only"),
        ("<p>unclosed <b>bold<p>next</p>", "unclosed bold\n\nnext"),
    ],
)
def test_blocks(source, text):
    assert ext.extract(source, None) == text


def page(k, body):
    return f"<html><body><div class=k1><p>Shop everything at Host</p><p>fresh {k} today</p></div><div class=k2><h1>Title {k}</h1>{body}</div><div class=k3><p>All rights kept</p></div></body></html>"


def test_templates_of_hosts(spark):
    rng = random.Random(1)
    words = [f"word{k}" for k in range(200)]
    bodies = ["".join(f"<p>{' '.join(rng.choice(words) for _ in range(40))}</p>" for _ in range(4)) for _ in range(12)]
    rows = [(k, f"http://host.example/{k}", page(k, b), "t") for k, b in enumerate(bodies)] + [(100, None, "<p>alone</p>", "t"), (101, "http://other.example/", None, "t"), (102, "odd", "", "t"), (0, "http://host.example/0", page(0, bodies[0]), "t")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = [(r.page_id, r.text, r.n_chars) for r in ext.extracted(pages).collect()]
    by_id = {i: t for i, t, _ in got}
    want = {k: "\n\n".join([f"Title {k}", *re.findall("<p>(.*?)</p>", b)]) for k, b in enumerate(bodies)}
    assert {k: by_id[k] for k in want} == want and len(got) == len(rows)
    assert by_id[100] == "alone" and by_id[101] == "" and by_id[102] == "" and all(n == len(t) for _, t, n in got)
    assert ext.extracted(pages.limit(0)).count() == 0


def test_extraction_of_generated_pages(spark):
    import html as entities

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r.text for r in ext.extracted(pages).collect()}
    for r in pages.collect():
        article = re.search("<article>(.*?)</article>", r.html, re.S)[1]
        parts = [" ".join(entities.unescape(re.sub("<[^>]*>", "", re.sub("<br>", " ", x))).split()) for x in re.split("</?(?:p|h1)>", article)]
        assert got[r.page_id] == "\n\n".join(p for p in parts if p)


def texts_of(spark, sources):
    pages = spark.createDataFrame([(k, f"http://host.example/{k}", s) for k, s in enumerate(sources)], "page_id long, url string, html string")
    return {r.page_id: r.text for r in ext.extracted(pages).collect()}


def test_copies_are_no_template(spark):
    rng = random.Random(3)
    body = lambda: "".join(f"<p>{' '.join(f'word{rng.randrange(200)}' for _ in range(40))}</p>" for _ in range(3))
    whole = lambda b, k: f"<html><body><nav>{k}</nav><article>{b}<p>All rights kept</p></article></body></html>"
    copied, others = body(), [body() for _ in range(3)]
    paragraphs = lambda b: "\n\n".join(re.findall("<p>(.*?)</p>", b))
    # copies with other menus, and the notice that all four distinct pages share
    got = texts_of(spark, [whole(copied, k) for k in range(60)] + [whole(b, 0) for b in others])
    assert all(got[k] == paragraphs(copied) for k in range(60)) and [got[60 + k] for k in range(3)] == [paragraphs(b) for b in others]
    # versions of one page
    got = texts_of(spark, [whole(f"<p>{k} o'clock</p>{copied}", k) for k in range(40)])
    assert all(paragraphs(copied) in text for text in got.values())


def test_all_regions_stay(spark):
    rng = random.Random(4)
    words = lambda n: " ".join(f"word{rng.randrange(200)}" for _ in range(n))
    parts = [(words(5), words(30), words(70)) for _ in range(12)]
    lead = [f"<html><body><h1>{a}</h1><div class=lead>{b}</div><div class=text><p>{c}</p></div><div class=k3><p>All rights kept</p></div></body></html>" for a, b, c in parts]
    two = [f"<html><body><div class=k0><p>Home of words</p></div><article class=a>{b}</article><article class=b>{c}</article></body></html>" for _, b, c in parts]
    assert texts_of(spark, lead) == {k: "\n\n".join(p) for k, p in enumerate(parts)}
    assert texts_of(spark, two) == {k: f"{b}\n\n{c}" for k, (_, b, c) in enumerate(parts)}


@pytest.mark.parametrize("n", [3, 9, 12])
def test_headings_that_articles_share_stay(spark, n):
    rng = random.Random(n)
    words = lambda k: " ".join(f"word{rng.randrange(400)}" for _ in range(k))
    parts = [(words(6), words(60), words(50)) for _ in range(n)]
    sources = [f"<html><body><article><h1>{a}</h1><h2>Introduction</h2><p>{b}</p><h2>Results</h2><p>{c}</p></article></body></html>" for a, b, c in parts]
    assert texts_of(spark, sources) == {k: f"{a}\n\nIntroduction\n\n{b}\n\nResults\n\n{c}" for k, (a, b, c) in enumerate(parts)}


def test_untold_templates(spark):
    """Neither articles nor telling names: links, notices and boxes around the text are told by the host's pages alone."""
    rng = random.Random(21)
    words = lambda k: " ".join(f"word{rng.randrange(400)}" for _ in range(k))
    sources, want = [], []
    for k in range(15):
        title, writer, body = words(5), words(2), [words(rng.randint(20, 60)) for _ in range(rng.randint(2, 5))]
        links = "".join(f"<li><a href=/{j}>{words(2)}</a></li>" for j in range(rng.randint(4, 9)))
        paragraphs = "".join(f"<p>{p}</p>" for p in body)
        box = f"<div class=q7><p>Join our readers now</p><p>{words(2)}</p></div>" if k % 3 else ""
        sources.append(f"<html><body><div class=q1><ul>{links}</ul></div><div class=q2>{words(3)}</div><div class=q3><h1>{title}</h1><p class=q4>{writer}</p><div class=q5>{paragraphs}<p class=q6>You are reading Host</p></div></div>{box}<div class=q8><p>Kept by Host</p><p>{rng.randrange(9)} visitors</p></div></body></html>")
        want.append("\n\n".join([title, writer, *body]))
    got = texts_of(spark, sources)
    assert got == dict(enumerate(want))
    assert all(ext.extract(s) != w for s, w in zip(sources, want, strict=True))  # markup alone doesn't tell


def test_classes_are_nested_in_one_order():
    root = [0, 10, 20, 30]
    assert ext.nested([root, [11, 13], [12, 25], [15, 14], [None, 5], [31, 40]]) == [False, False, True, True, False, False]
    assert ext.nested([[3, 1]]) == [True] and ext.nested([]) == []


def test_occurrence_vectors_make_classes(spark):
    """Tokens of one vector are one class; copies of a page count once."""
    page = lambda k: f"<body><div class=a><b>{k}</b></div>{'<i>x</i>' * (k % 2)}<p>{k}</p><p>{k} more</p></body>"
    rows = [("host", page(k), None) for k in range(6)] + [("few", page(1), None)]
    rows = [(h, s, 4 if s == page(2) else c) for h, s, c in rows] + [("host", page(2), 4)] * 3
    found = ext.classes(spark.createDataFrame(rows, "host string, html string, copies long")).collect()
    assert [r.host for r in found] == ["host"] and found[0].all_pages == 6
    assert [(c.pages, c["count"], len(c.tokens)) for c in found[0].classes] == [(6, 12, 1), (6, 6, 3), (3, 3, 1)]


def test_contamination(spark):
    rng = random.Random(2)
    words = [f"w{k}" for k in range(3000)]
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(12, 60)))) for k in range(30)]
    noise = lambda n: " ".join(rng.choice(words) for _ in range(n))
    docs, planted = [], set()
    for k, (item, text) in enumerate(items):
        docs.append((k, f"{noise(200)}. {text.upper()}, {noise(77)}", "x"))
        planted.add((k, item))
        swapped = [w if rng.random() > 0.15 else noise(1) for w in text.split()]
        docs.append((1000 + k, f"{noise(33)} {' '.join(swapped)} {noise(120)}", "x"))
    docs += [(2000 + k, noise(400), "x") for k in range(40)] + [(3000, None, "x"), (3001, "", "x"), (None, items[0][1], "x"), (0, docs[0][1], "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([*items, (99, None), (98, ""), (None, "x y")], "item_id long, text string")
    got = dec.contaminated(df, bench).collect()
    found = {(r.doc_id, r.item_id) for r in got}
    assert planted <= found and (None, 0) in found and not any(r.doc_id is not None and r.doc_id >= 2000 for r in got)
    paraphrased = sum((1000 + k, k) in found for k in range(30))
    assert paraphrased >= 27 and sum((r.doc_id, r.item_id) == (0, 0) for r in got) == 2
    assert dec.contaminated(df.limit(0), bench).count() == 0 and dec.contaminated(df, bench.limit(0)).count() == 0


def copies_found(spark, items, docs):
    """Of documents that hold the item of their number, those found with it."""
    df, bench = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {r.doc_id for r in dec.contaminated(df, bench).collect() if r.doc_id == r.item_id}


def common_slow(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for k, y in enumerate(b, 1):
            last, row[k] = row[k], last + 1 if x == y else max(row[k], row[k - 1])
    return row[-1]


def test_paraphrases_are_found(spark):
    """A quarter of an item's words replaced: recall of candidates and of the result against all common subsequences."""
    rng = random.Random(15)
    texts = [dec.words_of(r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(300).collect()]
    texts = [[w.decode() for w in t] for t in texts if len(t) >= 150]
    pool = [w for t in texts for w in t]
    items = [t[at : at + rng.randint(12, 60)] for t in texts[:60] for at in [rng.randrange(80)]]
    docs = []
    for k, item in enumerate(items):
        around, at = texts[60 + k % (len(texts) - 60)], rng.randrange(60)
        changed = list(item)
        for j in rng.sample(range(len(item)), len(item) // 4):
            changed[j] = rng.choice(pool)
        docs.append(around[:at] + changed + around[at:150])
    df = spark.createDataFrame([(k, " ".join(d)) for k, d in enumerate(docs)], "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(i)) for k, i in enumerate(items)], "item_id long, text string")
    pairs = {(d, i) for d, words in enumerate(docs) for i, item in enumerate(items) if common_slow(item, words) >= 0.65 * len(item)}
    planted = {(k, k) for k in range(len(items))}
    assert len(planted & pairs) >= 0.97 * len(planted)
    [index] = dec.indexed(df, bench, "text")
    searcher = dec.Searcher(index)
    met = {(d, index.items[j][0]) for d, words in enumerate(docs) for j in searcher.candidates([w.encode() for w in words])}
    found = {(r.doc_id, r.item_id) for r in dec.contaminated(df, bench).collect()}
    assert len(met & planted) >= 0.95 * len(planted) and len(found & planted) >= 0.9 * len(planted)
    assert len(found - planted) <= 0.05 * len(planted)


def test_passes_dont_change_results(spark, monkeypatch):
    docs, bench = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    whole = sorted(map(tuple, dec.contaminated(docs, bench).select("doc_id", "item_id", "lcs_share", "answer_share", "first_word").collect()))
    monkeypatch.setattr(dec, "ITEMS", 7)
    assert len(dec.indexed(docs, bench.selectExpr("item_id", "text"), "text")) > 5
    assert whole and whole == sorted(map(tuple, dec.contaminated(docs, bench).select("doc_id", "item_id", "lcs_share", "answer_share", "first_word").collect()))


def test_more_items_than_vectors(spark):
    rng = random.Random(5)
    noise = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    items = [noise(rng.randint(15, 30)) for _ in range(1500)]
    docs = [f"{noise(60)} {item} {noise(60)}" for item in items]
    assert copies_found(spark, items, docs) == set(range(1500))


def test_long_items(spark):
    rng = random.Random(6)
    noise = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    items = [noise(rng.choice([33, 700, 1500, 3000])) for _ in range(60)]
    docs = [f"{noise(60)} {item} {noise(60)}" for item in items]
    assert copies_found(spark, items, docs) == set(range(60))


def test_short_items_in_foreign_words(spark):
    rng = random.Random(7)
    noise = lambda n, k: " ".join(f"{k}{rng.randrange(20_000)}" for _ in range(n))
    common = [f"c{k}" for k in range(60)]
    items = [" ".join(rng.choice(common) for _ in range(rng.randint(6, 14))) for _ in range(60)]
    docs = [f"{noise(60, 'x')} {item} {noise(60, 'x')}" for item in items] + [f"{noise(100, 'x')} {' '.join(common)}" for _ in range(300)]
    assert copies_found(spark, items, docs) == set(range(60))


def test_latent_search_recalls_brute_force(spark):
    docs, bench = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in dec.contaminated(docs, bench).collect()}
    items = [(r.item_id, b" " + b" ".join(dec.words_of(r.text)) + b" ") for r in bench.collect()]
    want = {(r.doc_id, i) for r in docs.select("doc_id", "text").collect() for t in [b" " + b" ".join(dec.words_of(r.text)) + b" "] for i, x in items if x in t}
    assert want and len(want & got) >= 0.9 * len(want)


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES:
        before = kept
        kept = stage(spark, before, SF).cache()
        if name != "packing":
            assert kept.columns == docs.columns and 0 < kept.count() <= before.count()
        if name == "MinHash near-dedup":
            groups = near_duplicates(before, k=5).select("component_id").distinct().count()
            assert kept.count() == groups and near_duplicates(kept, k=5).where("not kept").count() == 0
        if name == "benchmark decontamination":
            assert dec.contaminated(kept, spark.read.parquet(f"{SF}/benchmark.parquet")).count() == 0
    assert kept.select("doc_id").distinct().count() == before.select("doc_id").distinct().count()


def near_groups(docs, k=5):
    """Ids that stay, by comparing all pairs of sets of k-word shingles."""
    def shingles(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())

    sets, stay = [shingles(t) for _, t in docs], []
    up = list(range(len(docs)))
    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                up[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(docs):
        if sets[i]:
            least[root(i)] = min(least.get(root(i), doc), doc)
        else:
            stay.append(doc)
    return sorted([*stay, *least.values()])


def test_near_dedup_stage_by_brute_force(spark):
    rng = random.Random(12)
    base = [[f"w{rng.randrange(300)}" for _ in range(80)] for _ in range(6)]
    rows = []
    for doc in range(60):
        words = list(rng.choice(base))
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(80)] = "new"
        rows.append((doc, " ".join(words)))
    rows += [rows[0], rows[0], (0, rows[0][1] + " more"), (70, None), (71, " "), (70, None)]
    docs = spark.createDataFrame([(*r, "en", "s", 5) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, SF).collect())
    assert got == near_groups(rows)


def test_substring_stage_drops_white_space(spark):
    passage = "a passage of more than fifty bytes that both documents hold in full"
    rows = [(1, passage), (2, f"{passage}\n\t\n"), (3, f"{passage} rest"), (4, None), (5, " \n")]
    docs = spark.createDataFrame([(*r, "en", "s", 5) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.substring_dedup(spark, docs, SF).collect()}
    assert got == {1: (passage, 5), 3: (" rest", 5), 4: (None, 5), 5: (" \n", 5)}


def test_registered():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert {f"op{n}_" for n in range(1, 11)} == {m[0] for n in names if (m := re.match(r"op\d+_", n))} and "pipeline" in names
