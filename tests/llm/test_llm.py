"""The operators for training data against brute force, exact invariants and dirty inputs."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skolion.llm import leakage, names, packing, residue, scans, similar, splitting


# ---- splitting


def test_cut_invariants():
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice(["a", "b ", ". ", "\n", "\n\n", "word ", "x" * rng.randint(1, 60), "1 Head\n", "- it "]) for _ in range(rng.randint(0, 250)))
        for limit, overlap in ((40, 10), (900, 150), (7, 0), (5, 4)):
            parts = splitting.cut(text, limit, overlap)
            if not text:
                assert parts == []
                continue
            assert parts[0][0] == 0 and parts[-1][1] == len(text)
            assert all(0 < b - a <= limit for a, b in parts)
            assert all(x == max(0, b - overlap) and y > b for (_, b), (x, y) in itertools.pairwise(parts))


def test_cut_prefers_natural_ends():
    text = "First sentence here. " * 60
    ends = [b for _, b in splitting.cut(text)][:-1]
    assert ends and all(text[:b].rstrip().endswith(".") for b in ends)


def test_tree_has_depths_and_nested_items():
    text = "# One\nintro\n## Two\n- a\n  - b\n  - c\n- d\n\nafter\n## Three\nx\n# Four\ny"
    root = splitting.tree(text)
    assert [text[n.start : n.end].split("\n")[0] for n in root.children] == ["# One", "# Four"]
    assert [text[n.start : n.end].split("\n")[0] for n in root.children[0].children] == ["# One", "## Two", "## Three"]
    listed = root.children[0].children[1].children[0]
    assert [text[n.start : n.end].split("\n")[0] for n in listed.children] == ["## Two", "- a", "- d"] and len(listed.children[1].children) == 3


def test_no_piece_mixes_a_part_of_an_oversized_section_with_its_neighbour():
    rng = random.Random(3)
    for _ in range(200):
        sections = [f"{'#' * rng.randint(1, 3)} Head {i}\n" + "Some words stand here. " * rng.randint(1, 90) + "\n" for i in range(rng.randint(2, 6))]
        text, bounds, at = "".join(sections), [], 0
        for s in sections:
            bounds.append((at, at + len(s)))
            at += len(s)
        ends = splitting.pack(text, splitting.tree(text), 750)
        for a, b in zip([0, *ends], ends):
            touched = [(x, y) for x, y in bounds if x < b and y > a]
            assert b - a <= 750 and (len(touched) == 1 or all(a <= x and y <= b for x, y in touched))


def test_small_siblings_share_a_piece():
    text = "".join(f"# H{i}\n" + "Words stand here. " * 5 + "\n" for i in range(30))
    ends = splitting.pack(text, splitting.tree(text), 750)
    assert all(text[e : e + 1] in ("#", "") for e in ends) and len(ends) <= -(-len(text) // 600)


def test_white_space_over_pages(spark):
    """A chunk that starts before more than 64 blanks, a page's end and an empty page."""
    page = ["word. " * 50 + " " * 90, "", "\n  " + "Next page goes on. " * 100]
    at, rows = 0, []
    for i, t in enumerate(page):
        rows.append(("p", i + 1, t, at, at + len(t)))
        at += len(t) + 1
    full = "\n".join(page)
    chunks = spark.createDataFrame([("p::0", "p", full[310:].strip(), 310, 1, None, 1, 0)], CHUNKS)
    out = splitting.located(splitting.pieces(chunks), spark.createDataFrame(rows, "paper_id string, page_number int, text string, char_start int, char_end int")).collect()
    assert len(out) >= 2 and all(full[r.char_start : r.char_end] == r.text and r.page_start == r.page_end == 3 for r in out)


CHUNKS = "chunk_id string, paper_id string, text string, char_start int, page_start int, received_at timestamp, delivery_id bigint, begin int"


def test_pieces_and_places(spark):
    body = "".join(f"Sentence number {i} stands here. " for i in range(120))
    page1, page2 = body[:1500], body[1501:]
    pages = spark.createDataFrame([("p", 1, page1, 0, 1500), ("p", 1, page1, 0, 1500), ("p", 2, page2, 1501, 1501 + len(page2)), ("p", 3, None, None, None), ("q", 1, "", 0, 0)], "paper_id string, page_number int, text string, char_start int, char_end int")
    full = page1 + "\n" + page2
    rows = [("p::1", "p", full[200:2400].strip(), 200, 1, None, 1, 7), ("p::1", "p", full[200:2400].strip(), 200, 1, None, 2, 7), ("p::2", "p", "short", 0, 1, None, 3, 7), (None, "p", "x" * 2000, 0, 1, None, 4, 7), ("p::3", "p", None, 0, 1, None, 5, 7), ("z::0", "z", "y" * 2000, 10, 4, None, 6, 7)]
    chunks = spark.createDataFrame(rows, CHUNKS)
    out = splitting.located(splitting.pieces(chunks), pages).collect()
    mine = sorted((r for r in out if r.chunk_id == "p::1"), key=lambda r: r.piece_no)
    for r in mine:
        assert full[r.char_start : r.char_end] == r.text and r.n_tokens == len(r.text.split()) and len(r.text) <= 900
        assert r.page_start == (1 if r.char_start < 1500 else 2) and r.page_end == (1 if r.char_end - 1 <= 1500 else 2)
    assert {r.chunk_id for r in out} == {"p::1", "z::0"}
    assert all(r.page_start == 4 for r in out if r.chunk_id == "z::0")


def test_pieces_of_nothing(spark):
    assert splitting.pieces(spark.createDataFrame([], CHUNKS)).count() == 0


# ---- packing


def test_difference_balances():
    rng = np.random.default_rng(0)
    for k in (2, 3, 7):
        sizes = rng.integers(1, 100, 60)
        sums = np.bincount(packing.difference(sizes, k), weights=sizes, minlength=k)
        assert sums.max() - sums.min() <= 3 and sums.sum() == sizes.sum()


def test_windows(spark):
    rng = np.random.default_rng(1)
    sizes = [0, 5000, 2048, 4096, *(int(x) for x in rng.integers(1, 900, 300))]
    rows = [(i, s) for i, s in enumerate(sizes)] + [(7, sizes[7]), (None, 10)]
    out = packing.pack(spark.createDataFrame(rows, "doc_id bigint, n_tokens int"), group=100).toPandas()
    assert out.n_tokens.sum() == sum(s for _, s in rows)
    assert out.groupby("window_id").n_tokens.sum().max() <= 2048
    assert (out.token_end - out.token_start == out.n_tokens).all()
    split = out.groupby(["doc_id", "copy"], dropna=False).size()
    assert {k[0] for k, n in split.items() if n > 1} == {1.0, 3.0}
    assert out[out.n_tokens == 0].window_id.isna().all()
    windows = out.window_id.nunique()
    assert windows <= -(-sum(s for _, s in rows) // 2048) + 5


def test_packing_nothing_and_token_counts(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id bigint, n_tokens int")).count() == 0
    got = {r.doc_id: r.n_tokens for r in packing.token_counts(spark.createDataFrame([(1, "Hello world"), (2, None), (3, ""), (4, "<|endoftext|>")], "doc_id bigint, text string")).collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] > 1


# ---- similar vectors


def _brute(rows, k):
    data = {}
    for i, v in rows:
        if i is not None and v is not None and any(v) and (i not in data or v < data[i]):
            data[i] = v
    ids = sorted(data)
    m = np.array([data[i] for i in ids], dtype=np.float32).astype(float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    s = np.round(m @ m.T, 12)
    return {ids[a]: [ids[b] for b in sorted((b for b in range(len(ids)) if b != a), key=lambda b: (-s[a, b], ids[b]))[:k]] for a in range(len(ids))}


def test_neighbours_equal_brute_force_and_copies_tie_by_name(spark):
    rng = np.random.default_rng(2)
    rows = [(f"p{i:03d}", [float(x) for x in rng.normal(size=6)]) for i in range(60)]
    rows += [(f"c{i:02d}", [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]) for i in range(25)] + [rows[0], ("z", [0.0] * 6), ("n", None), (None, [1.0] * 6), ("short", [1.0, 2.0]), ("nan", [float("nan")] * 6)]
    df = spark.createDataFrame(rows, "paper_id string, embedding array<float>").withColumn("unit", F.lit(1))
    got = {}
    for r in sorted(similar.neighbours(df).collect(), key=lambda r: r["rank"]):
        got.setdefault(r.paper_id, []).append(r.neighbour)
    usable = [r for r in rows if r[0] not in ("short", "nan")]
    assert got == _brute(usable, 8)


def test_tree_recall(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 16))
    rows = [(f"{i:05d}", [float(x) for x in centres[i % 30] + 0.3 * rng.normal(size=16)]) for i in range(1500)]
    df = spark.createDataFrame(rows, "paper_id string, embedding array<float>").repartition(4)
    truth = _brute(rows, 8)
    for config in (similar.SearchConfig(sample=600, leaf=100, block=64, part=500, queries=100), similar.SearchConfig(sample=64, leaf=12, block=50, part=300, queries=200)):
        found = similar.neighbours(df, config=config).collect()
        hits = sum(r.neighbour in truth[r.paper_id] for r in found)
        assert len(found) == 8 * len(rows) and hits / len(found) >= 0.95
    assert similar.neighbours(df.limit(0)).count() == 0


def test_tasks_hold_no_vector_once_a_visit(spark):
    """Frames have a row a vector, however many leaves it visits, and a leaf's visitors aren't all doubles at once."""
    import tracemalloc

    import pandas as pd

    x = similar._unit(np.random.default_rng(2).normal(size=(3000, 64)))
    tree = similar.fit(x, 8, 8)
    rows = pd.DataFrame({"unit": np.arange(3000), "v": list(x.astype(np.float32))})
    find = similar._visitor(tree, 40)
    found = similar.visited(rows, "top", find)
    assert len(found) == len(rows) and all(len(set(at)) == 40 for at in found["top"])
    many = np.empty(12_000, object)
    many[:] = list(np.random.default_rng(3).normal(size=(12_000, 384)).astype(np.float32))
    tracemalloc.start()
    got = similar.nearest(np.arange(12_000), many, np.arange(12_000) >= 500, 8)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got) == 8 * 11_500 and peak < 11_500 * 384 * 8


def test_leaves_grow_with_the_table(spark):
    """The sample of each tree is fixed; twice as many rows have about twice as many leaves, of the same size."""
    rng = np.random.default_rng(4)
    leaves = []
    for n in (1500, 3000):
        df = spark.createDataFrame([(f"{i:05d}", [float(x) for x in rng.normal(size=12)]) for i in range(n)], "unit string, v array<float>")
        forest = similar.index(df, n, similar.SearchConfig(sample=64, leaf=40))
        assert forest.upper.leaves <= 64 and forest.rows.count() == n
        leaves.append(forest.rows.groupBy("top", "low").count().count())
    assert leaves[0] >= 20 and 1.4 * leaves[0] <= leaves[1]


# ---- leakage


def test_leaks_are_exact(spark):
    q = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    docs = [
        (1, f"intro {q} outro"), (2, "ONE, two three -  four (five) six\nseven eight nine ten ele-\nven twelve."), (3, " ".join(q.split()[:11])), (4, " ".join(q.split()[1:13])),
        (5, None), (6, ""), (7, "w " * 50_000 + q), (1, f"intro {q} outro"), (None, q), (8, " ".join(q.split()[:6] + ["x"] + q.split()[6:])),
    ]
    items = [(10, q, None), (11, "too short to matter", ""), (12, None, "alpha " * 12), (13, q, q)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("item", F.lit("clash"))
    i = spark.createDataFrame(items, "item_id bigint, question string, reference_answer string")
    want = {(doc, item) for doc in (1, 2, 4, 7) for item in (10, 13)}
    for block in (leakage.BLOCK, 3):
        out = leakage.leaked(d, i, block=block).collect()
        assert {(r.doc_id, r.item_id) for r in out} == want and len(out) == len(want)
    assert leakage.leaked(d.limit(0), i).count() == leakage.leaked(d, i.limit(0)).count() == 0


# ---- residue

RESIDUE = ["We use {{dataset}} here.", "Title: TBD", "<%= abstract %>", "Sorry, this document failed to load.", "Lorem ipsum dolor sit amet.", "test test test test test test test", "Accès refusé (403).", "null null null", "To see it you have to allow scripts and cookies.", "Good text. Ihre Sitzung ist abgelaufen. More text."]
CLEAN = ["The variable ${HOME} names a folder.", "Lorem ipsum is a known artefact of crawled corpora.", "Pages that answered 404 were removed from the crawl.", "Let {a, b} denote an interval.", "Both sessions share errors and scripts of the server.", "", "A viewer that asks readers to enable JavaScript counts as a failure.", "Macros of the form <%= name %> are parsed."]


def test_residue_rules(spark):
    rows = [(i, t, "s") for i, t in enumerate(RESIDUE)] + [(100 + i, t, "s") for i, t in enumerate(CLEAN)] + [(200, None, None), (201, "word " * 100_000 + "{{slot_x}}", None), (0, RESIDUE[0], "s")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("h", F.lit(1)).withColumn("s", F.lit(2))
    got = sorted(r.doc_id for r in residue.residue(df).collect())
    assert got == [*range(len(RESIDUE)), 201]
    assert residue.clean(df).count() == len(CLEAN) + 1
    assert residue.residue(df.limit(0)).count() == 0


def test_messages_count_where_they_recur(spark):
    text = "Please reload this page of the viewer {} now."
    rows = [(i, text.format(i), f"s{i % 2}") for i in range(4)] + [(9, "Reload the matrix into the solver 7 then.", "s1")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    assert sorted(r.doc_id for r in residue.residue(df).collect()) == [0, 1, 2, 3]


def test_recurring_notices_outside_the_phrases(spark):
    """Every segment is grouped; a notice that no phrase knows counts where it recurs, also within one source."""
    rows = [(i, f"Real text number {'abc'[i]}{'xyz'[i]}. Incident {i}7.", f"s{i % 2}") for i in range(3)]
    rows += [(10 + i, f"Your subscription does not cover volume {i}.", "large") for i in range(10)]
    rows += [(30 + i, "Your connection is slow.", "small") for i in range(3)] + [(40, "Incident rates fell.", "s0"), (50, "Wait 5 minutes.", "s0")]
    rows += [(60 + i, "Abstract", f"s{i % 3}") for i in range(12)] + [(80 + i, "The model reads every page.", f"s{i % 3}") for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    assert sorted(r.doc_id for r in residue.residue(df).collect()) == [0, 1, 2, *range(10, 20)]


def test_messages_that_no_single_rule_knows_count_by_recurrence(spark):
    said = ["503 Backend fetch failed. Guru Meditation: XID 99{}", "We are having trouble showing you this article right now.", "Dear %recipient%, thanks for your order"]
    long = "You can read the whole of this article, with all of its tables, its figures, its notes and its supplements, on any device that is connected with the network of a library that takes part in the programme, at any time."
    rows = [(100 * j + i, f"Real text {i} stands here. {m.format(i)}\nMore of it.", f"s{i % 7}") for j, m in enumerate([*said, long]) for i in range(60)]
    df = spark.createDataFrame([*rows, (900, long, "s0"[:1])], "doc_id bigint, text string, source string")
    found = {r.doc_id: r for r in residue.evidence(df).collect()}
    assert set(found) == {r[0] for r in rows} | {900} and all(r.recurring for r in found.values())
    once = spark.createDataFrame([rows[0], rows[60], rows[180]], "doc_id bigint, text string, source string")
    assert residue.evidence(once).count() == 0


# ---- names


def test_slips_and_similarity():
    assert names.slips("abcd", "abdc") == 1 and names.slips("abc", "abcd") == 1 and names.slips("abc", "xyz") == 3
    assert names.monge_elkan(["w", "roe"], ["william", "roe"]) == 1.0 and names.monge_elkan([], ["a"]) == 0.0
    assert names.bands_for(0.5, 0.98, 4) == 61


def test_variants_of_people_and_organisations(spark):
    groups = [
        ["William Q. Zarkoviak", "Bill Zarkoviak", "Zarkoviak, William", "W. Zarkoviak", "ZARKOVIAK WILLIAM", "Dr. William Zarkovaik", "william zarkoviak"],
        ["Jürgen Mönkholt", "Juergen Moenkholt", "Jurgen Monkholt"],
        ["Anna Zarkoviak"], ["Karl Mendel-Ross", "Karl Mendel Ross"],
        ["Northby Institute of Data Ethics", "Institute of Data Ethics, Northby", "Northby IDE", "The Northby Inst. Data Eth."], ["Northby Institute of Document Research"],
        ["???"],
    ]
    rows = [(n,) for g in groups for n in g] + [(None,), (" ",), ("William Q. Zarkoviak",), ("William Tor",), ("William Benn",), ("Anna Tor",)]
    found = names.entities(spark.createDataFrame(rows, "name string"))
    pairs = {(r.name_a, r.name_b) for r in names.variant_pairs(found).collect()}
    assert pairs == {tuple(sorted(p)) for g in groups for p in itertools.combinations(g, 2)}
    assert names.variant_pairs(names.entities(spark.createDataFrame([], "name string"))).count() == 0


def _entities(spark, names_):
    found = names.entities(spark.createDataFrame([(n,) for n in names_], "name string")).collect()
    out = {}
    for r in found:
        out.setdefault(r.entity, set()).add(r.name)
    return sorted(map(sorted, out.values()))


def test_slips_in_several_notations_are_linked(spark):
    own = ["Margaret Thornbury", "M. Thornbury", "Margaret Thornbruy", "M. Thornbruy"]
    assert _entities(spark, own) == [sorted(own)]


def test_initials_of_several_people_stay_alone(spark):
    assert _entities(spark, ["John Smith", "Jane Smith", "James Smith", "J. Smith", "Jane Doe", "Jane Do"]) == [["J. Smith"], ["James Smith"], ["Jane Do"], ["Jane Doe"], ["Jane Smith"], ["John Smith"]]


def test_organisations_of_different_kinds_stay_apart(spark):
    assert len(_entities(spark, ["Denagate Academy of Language Technology", "Denagate University of Language Technology", "The Denagate Univ. of Language Technology"])) == 2


def test_no_table_of_names_goes_through_the_driver(spark):
    people = [f"{given} {last}" for given in ("John", "Jane", "Jon") for last in ("Smithson", "Smithsen", "Doerfler")] + ["J. Doerfler"]
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    names.variant_pairs(names.entities(spark.createDataFrame([(n,) for n in people], "name string"))).collect()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    plans = store.executionsList(int(before), 1000)
    assert plans.size() > 5
    assert not [i for i in range(plans.size()) if "BroadcastExchange" in plans.apply(i).physicalPlanDescription()]


def test_stars_close_every_edge(spark):
    """A chain of falling weights needs a round for every second node."""
    n = 34
    weights = spark.createDataFrame([(f"n{i:02d}", n - i) for i in range(n)], "node string, weight int")
    edges = spark.createDataFrame([(f"n{i:02d}", f"n{i + 1:02d}", 0.9) for i in range(n - 1)], "a string, b string, similarity double")
    home = {r.node: r.centre for r in names.stars(weights, edges).collect()}
    assert len(home) == n and all(home[f"n{i:02d}"] == f"n{i - i % 2:02d}" for i in range(n))


def test_equal_parts_collide_in_every_band_and_slips_by_the_curve():
    b = names.Banding()
    assert (names.band_keys("smith", "x", b) == names.band_keys("smith", "x", b)).all() and not set(names.band_keys("smith", "x", b)) & set(names.band_keys("smith", "y", b))
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9)) for _ in range(200)]
    met = sum(bool(set(names.band_keys(w, "", b)) & set(names.band_keys(w[:4] + w[5] + w[4] + w[6:], "", b))) for w in words)
    assert met >= 190


# ---- scans

WORDS = "the model reads every sentence of a page before it answers any question about its figures and tables while readers wait for results".split()


def _page(rng, lines=24, width=9):
    out = []
    for i in range(lines):
        s = " ".join(rng.choice(WORDS) for _ in range(width))
        out.append((s.capitalize() if i % 6 == 0 else s) + ("." if i % 6 == 5 else ""))
    return "\n".join(out)


@pytest.fixture(scope="module")
def scanned(spark):
    rng = random.Random(4)
    clean = [_page(rng) for _ in range(80)]
    rows = [("p", i + 1, t, i * 5000, i * 5000 + len(t)) for i, t in enumerate(clean)]
    noisy = {
        81: "Page 81\n" + _page(rng), 82: _page(rng) + "\n— 82 —", 83: "QUARLE ET AL. ON THE ZEBULON OF M\n" + _page(rng), 84: _page(rng).replace("model", "rnodel"), 85: _page(rng) + "\nlast sen-\ntence of it",
        86: _page(rng).replace("reads", "re°ads"), 87: "Quarlesund et al.\n" + _page(rng),
    }
    rows += [("p", n, t, n * 5000, n * 5000 + len(t)) for n, t in noisy.items()]
    rows += [("p", 90, None, 450_000, 450_000), ("p", 91, "", 455_000, 455_000), rows[0], ("q", 1, "word " * 60_000, 0, 300_000)]
    chunks = [("p::1", "p", rows[0][2][:300], 0), ("p::2", "p", noisy[81][:250], 81 * 5000), ("p::3", "p", noisy[81][100:400], 81 * 5000 + 100), ("p::4", None, noisy[85], None), ("p::5", "p", None, 3), ("p::6", "p", noisy[84], 84 * 5000)]
    pages = spark.createDataFrame(rows, "paper_id string, page_number int, text string, char_start int, char_end int").withColumn("key", F.lit("k"))
    return pages, spark.createDataFrame(chunks, "chunk_id string, paper_id string, text string, char_start int").withColumn("begin", F.lit(1)), noisy


def test_noise_is_found(scanned):
    pages, chunks, noisy = scanned
    got = {(r.record_kind, r.record_key) for r in scans.noisy_records(pages, chunks).collect()}
    assert got == {("page", f"p#{n}") for n in noisy} | {("chunk", "p::2"), ("chunk", "p::4"), ("chunk", "p::6")}


def test_repair(scanned):
    pages, chunks, noisy = scanned
    out = {r.record_key: r.text for r in scans.repaired(pages, chunks).collect()}
    assert set(out) == {f"p#{n}" for n in noisy} | {"p::2", "p::4", "p::6"}
    assert "Page 81" not in out["p#81"] and "sentence of it" in out["p#85"] and "rnodel" not in out["p#84"] and "reads" in out["p#86"]
    assert scans.noisy_records(pages.limit(0), chunks.limit(0)).count() == 0


def _scan_rows(spark, pages, chunks=()):
    rows = [(k, n, t, (n - 1) * 9000, (n - 1) * 9000 + len(t)) for k, n, t in pages]
    return (
        spark.createDataFrame(rows, "paper_id string, page_number int, text string, char_start int, char_end int"),
        spark.createDataFrame(list(chunks), "chunk_id string, paper_id string, text string, char_start int"),
    )


def test_verdicts_do_not_hang_on_the_vocabulary(spark, monkeypatch):
    """Wrapped compounds are clean and words of any length or rarity are corrected, whatever fits into KNOWN."""
    rng = random.Random(9)
    long = "donaudampfschifffahrtsgesellschaftskapitaensmuetzen"
    body = [("p", i + 1, _page(rng).replace("question", "semi").replace("figures", "automatic").replace("readers", long, 1)) for i in range(60)]
    body += [("p", 70, _page(rng) + "\nThe semi-\nautomatic model reads on."), ("p", 71, _page(rng) + "\nThe sen-\ntence waits for it."), ("p", 72, _page(rng) + f"\nThe {long.replace('m', 'rn', 1)} reads on."), ("p", 73, _page(rng) + "\nThe sentence waits.")]
    pages, chunks = _scan_rows(spark, body)
    for size in (200_000, 20):
        monkeypatch.setattr(scans.known_words, "__defaults__", (size,))
        assert {r.record_key for r in scans.noisy_records(pages, chunks).collect()} == {"p#71", "p#72"}


def test_chunks_without_a_page_are_labelled(spark):
    rng = random.Random(5)
    pages, chunks = _scan_rows(spark, [("p", i + 1, _page(rng)) for i in range(80)], [("lone::0", "lone", "its figures\n— 14 —\n" + _page(rng), 0), ("lone::1", "lone", "its figures\nand tables\n" + _page(rng), None)])
    assert {r.record_key for r in scans.noisy_records(pages, chunks).collect()} == {"lone::0"}


def test_repaired_text(spark):
    rng = random.Random(12)
    body = [("p", i + 1, _page(rng)) for i in range(80)]
    noisy = "Page 90\n" + "The rnodel reads every sen-\ntence of a page before it answers\nany question about its fig`ures.\n" + _page(rng)
    out = scans.repaired(*_scan_rows(spark, [*body, ("p", 90, noisy)])).collect()
    assert len(out) == 1 and out[0].text.startswith("The model reads every sentence of a page before it answers any question about its figures.")


def test_chain_is_fitted_jointly():
    """Two labels that only the one before can tell apart."""
    pages = []
    for i in range(40):
        x = np.zeros((6, scans.FEATURES))
        x[:, 0] = 1
        x[0, 13] = i % 2
        pages.append((x, [scans.BREAK if (t + i) % 2 else scans.BODY for t in range(6)]))
    model = scans.fit_chain(pages)
    assert model.moves[scans.BODY, scans.BREAK] > model.moves[scans.BODY, scans.BODY] + 1 and model.moves[scans.BREAK, scans.BODY] > model.moves[scans.BREAK, scans.BREAK] + 1


def test_filters_let_all_members_pass(spark):
    import xxhash

    words = [f"w{i}é" for i in range(3000)]
    bits = scans.bit_filter(spark.createDataFrame([(w,) for w in words], "w string").select(F.xxhash64("w")))
    passed = lambda w: scans._set(bits, xxhash.xxh64_intdigest(w, 42))
    assert all(map(passed, words)) and sum(passed(f"v{i}") for i in range(3000)) < 30


def test_paragraphs_follow_the_labels_of_the_model():
    """A break is where the sequence model says so, whatever the fixed rule says, in pages and in chunks alike."""
    text = "Page 7\nthe model reads every word\nof the page be-\nfore it\nanswers the ques-\ntions\nand waits\n8"

    class Model(scans.LineModel):
        def label(self, lines, known, headers=None):
            assert lines == text.split("\n") and headers == {0, 7}
            return [scans.HEADER, scans.BODY, scans.BREAK, scans.BODY, scans.BODY, scans.BODY, scans.BREAK, scans.HEADER]

    reader = scans.Reader(Model(None, None, None, None), frozenset())
    out = scans.rebuild(text, [(0, 6), (len(text) - 1, len(text))], {}, set(), reader)
    assert out == "the model reads every word\nof the page before it answers the questions\nand waits"


def test_given_headers_bind_the_labels():
    rng = random.Random(6)
    model = scans.train([_page(rng) for _ in range(40)], frozenset(WORDS))
    lines = ["Page 3", *_page(rng).split("\n")]
    assert model.label(lines, frozenset(WORDS))[0] == scans.HEADER
    assert scans.HEADER not in model.label(lines, frozenset(WORDS), set())
    assert [i for i, x in enumerate(model.label(lines, frozenset(WORDS), {4})) if x == scans.HEADER] == [4]


def test_headers_of_narrow_pages_may_be_as_long_as_lines():
    rng = random.Random(8)
    model = scans.train([_page(rng, width=w) for w in (7, 8, 9, 12) for _ in range(20)], frozenset(WORDS))
    for head in ("Preprint. Under review by Duzonandez", "QUASTZEENG: STABLE SEARCH SPACE DESIGN FOR RAN", "Does a Cheap Head Help Forecasting . . . 8"):
        lines = [head, *_page(rng, width=7).split("\n")]
        assert len(head) >= 0.75 * scans._width(lines)
        assert [i for i, label in enumerate(model.label(lines, frozenset(WORDS))) if label == scans.HEADER] == [0]


def test_tasks_without_rows(spark, tmp_path):
    """Files of fewer rows than tasks leave some tasks without any."""
    spark.createDataFrame([("p", 1, "Some text of a page. " * 20, 0, 420)], "paper_id string, page_number int, text string, char_start int, char_end int").write.parquet(str(tmp_path / "p"))
    pages = spark.read.parquet(str(tmp_path / "p")).repartition(4)
    chunks = spark.createDataFrame([("p::0", "p", "Some text of a page.", 0)], "chunk_id string, paper_id string, text string, char_start int").repartition(4)
    assert scans.noisy_records(pages, chunks).count() == scans.repaired(pages, chunks).count() == 0
    docs = spark.createDataFrame([(1, "a b c")], "doc_id bigint, text string").repartition(4)
    items = spark.createDataFrame([(2, "x " * 12)], "item_id bigint, question string").repartition(4)
    assert leakage.leaked(docs, items, fields=("question",)).count() == 0
    assert names.entities(spark.createDataFrame([("?",)], "name string").repartition(4)).count() == 1
    assert packing.pack(packing.token_counts(docs)).count() == 1
    assert similar.neighbours(spark.createDataFrame([("a", [1.0])], "paper_id string, embedding array<float>").repartition(4)).count() == 0
