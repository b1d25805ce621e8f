"""The corpus operators against brute force on small tables with nulls, empty and repeated rows, ties and odd columns."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from loanvane.llm import class_lm, components, factorization, group_join, line_cleaning, mixing, positional_index, rule_ensemble, sharding, site_tree, zip_warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, copies int, h string, n string"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


@pytest.fixture(scope="module")
def rows():
    """Documents with copies, near copies, a passage, nulls, repeated rows and extra columns of clashing names."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdeé", k=rng.randint(1, 7))) for _ in range(400)]
    text = lambda n: " ".join(rng.choices(vocabulary, k=n))
    base, passage, texts = text(80), text(60), []
    for i in range(160):
        if i % 8 == 0:
            own = base.split(" ")
            for _ in range(rng.randint(0, 3)):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            texts.append(" ".join(own))
        elif i % 8 == 1:
            texts.append(text(rng.randint(1, 40)) + "\n" + passage)
        elif i % 8 == 2:
            texts.append(base.upper())
        else:
            texts.append(text(rng.choice([0, 1, 4, 5, 30, 200])))
    texts += [None, "", " \n\t", "word", "a b c d", "x " * 3000, "| | menu | home |\n" * 30, "Good line here.\n" * 60]
    out = [(i, t, "en", [None, "b", "a", "é"][i % 4] if i % 3 else "hot", len(t or ""), "s", 7, "h", "n") for i, t in enumerate(texts)]
    return [*out, out[3], out[3], out[160]]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(5).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def found(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


# ---------------------------------------------------------------- 1


@pytest.mark.parametrize("limit", [1, 700, 5000, 10**9])
def test_shards_fit_and_are_as_coarse_as_possible(docs, rows, limit):
    out = sharding.extendible_shards(docs, limit).collect()
    assert len(out) == len(rows)
    sizes = collections.Counter()
    for r in out:
        assert r["row_bytes"] == len((r["text"] or "").encode())
        sizes[r["shard"]] += r["row_bytes"]
    largest = collections.Counter()
    for r in out:
        largest[r["shard"]] = max(largest[r["shard"]], r["row_bytes"])
    assert all(n <= limit or n == largest[s] for s, n in sizes.items())
    # a sibling pair that fits together would be one shard
    at = {tuple(map(int, s.split("-")[:2])): n for s, n in sizes.items() if s.endswith("-0")}
    for (depth, prefix), n in at.items():
        other = at.get((depth, prefix ^ 1))
        assert depth == 0 or other is None or n + other > limit


def test_shards_of_one_key_overflow_into_pages(spark):
    same = spark.createDataFrame([(7, "x" * 40)] * 50, "doc_id long, text string")
    out = sharding.extendible_shards(same, 100).collect()
    sizes = collections.Counter()
    for r in out:
        sizes[r["shard"]] += r["row_bytes"]
    assert len(out) == 50 and max(sizes.values()) <= 100


def test_shards_of_nothing(none):
    assert sharding.extendible_shards(none).count() == 0


# ---------------------------------------------------------------- 2, 3


def test_rules_find_a_planted_quality(spark):
    rng = random.Random(1)
    bad = lambda: " ".join("".join(rng.choices("abc", k=4)) + rng.choice(["###", "%%%"]) for _ in range(60))
    good = lambda: " ".join("".join(rng.choices("abcdefg", k=5)) for _ in range(60)) + "."
    data = [(i, good() if i % 3 else bad(), int(bool(i % 3))) for i in range(300)] + [(900, None, None), (901, "", None)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in data], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y, 0) for i, _, y in data if y is not None], "doc_id long, quality int, toxic int")
    out = found(rule_ensemble.quality(docs, labels))
    assert len(out) == len(data) and all(0 <= r["score"] <= 1 for r in out.values())
    assert all(out[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _, _ in data)
    assert all(out[i]["predicted"] == y for i, _, y in data if y is not None)
    assert len({r["score"] for i, r in out.items() if i >= 900}) == 1


def test_rules_are_conjunctions_of_the_trees_and_compile_to_columns(spark):
    ensemble = rule_ensemble.RuleEnsemble((rule_ensemble.Rule((("n_words", True, 5.0), ("bars", False, 0.5))),), (2.0,), -1.0)
    rows = spark.createDataFrame([(6.0, 0.0), (5.0, 0.0), (9.0, 0.9)], "n_words double, bars double")
    got = [r[0] for r in rows.select(ensemble.column()).collect()]
    assert got == pytest.approx([1 / (1 + math.exp(-1)), 1 / (1 + math.exp(1)), 1 / (1 + math.exp(1))])


def test_machine_learns_pairs_that_a_sum_cannot(spark):
    """Insult and group together are toxic, each alone is not: weights that only add up cannot tell."""
    rng = random.Random(2)
    rows = []
    for _ in range(800):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        noise = [f"w{rng.randint(0, 30)}" for _ in range(8)]
        rows.append((" ".join(noise + ["insultx"] * a + ["groupx"] * b), int(a and b)))
    machine = factorization.fit_machine(spark.createDataFrame(rows, "text string, y int"))
    assert machine.score("w1 insultx groupx") > 0.7
    assert max(machine.score("w1 insultx"), machine.score("w1 groupx"), machine.score("w1"), machine.score(None)) < 0.5


def test_scores_without_labels_are_the_same_for_all(spark, docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for scored in (factorization.toxicity(docs, labels), rule_ensemble.quality(docs, labels)):
        assert len({r["score"] for r in scored.collect()}) == 1


def test_scores_of_nothing(spark, none):
    labels = spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int")
    assert factorization.toxicity(none, labels).count() == rule_ensemble.quality(none, labels).count() == 0


# ---------------------------------------------------------------- 4


PAGE = """<!DOCTYPE html><html><head><title>t</title><script>var a = "</p><p>no";</script></head><body class="post nav">
<header>top</header><nav><ul><li>a<li>b</ul></nav><div class="ad-box">buy</div><div id="cookieNotice">eat</div>
<article><h1>Head &amp; <b>li</b>ne</h1><p>One<br>two <i>th</i>ree &#233;&amp<p>four<!-- no --><form>no</form>
<table><tr><td>c1<td>c2</table><div class="comments">no</div></article><aside>no</aside><footer>&copy; no</footer>"""


def test_page_text():
    assert site_tree.main_text(PAGE) == "Head & line One two three é& four c1 c2"
    assert site_tree.main_text(None) == site_tree.main_text("") == ""
    assert site_tree.main_text("plain < 3 &lt;b&gt; <unclosed") == "plain < 3 <b>"
    assert site_tree.main_text("<div>" * 3000 + "deep") == "deep"


def test_repeated_branches_of_a_host_go(spark):
    page = lambda i: f"<html><body><div><p>Follow us, all ways.</p></div><section><p>Text number {i} says {i * i} things</p></section></body></html>"
    rows = [(i, "http://One.example/x", page(i)) for i in range(9)] + [(20, "http://two.example/", page(1)), (21, None, None), (22, "x", "")]
    out = found(site_tree.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")), "page_id")
    assert out[3]["text"] == "Text number 3 says 9 things" and out[3]["n_chars"] == 27
    assert out[20]["text"] == "Follow us, all ways. Text number 1 says 1 things"
    assert out[21]["text"] == out[22]["text"] == "" and out[21]["n_chars"] == 0


def test_equal_articles_of_a_host_stay(spark):
    rows = [(i, "http://one.example/", "<body><div>same text on every page here</div></body>") for i in range(9)]
    out = found(site_tree.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")), "page_id")
    assert {r["text"] for r in out.values()} == {"same text on every page here"}


def main_texts(spark, pages):
    rows = [(i, f"http://{host}/{i}", page) for i, (host, page) in enumerate(pages)]
    return [r["text"] for r in sorted(site_tree.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect(), key=lambda r: r["page_id"])]


def test_importance_and_not_names_chooses_branches(spark):
    bare = lambda i: f"<body><div><p>Home</p><p>All news</p></div><div><p>Bare {i} <b>tells</b> of {i * i}</p></div><div>Write to us</div></body>"
    meta = lambda i: f"<body><div class='post-meta'>All rights kept</div><div>Meta {i} tells of {i * i}</div></body>"
    form = lambda i: f"<body><form id='f'><nav>go {i}</nav><div>Form {i} tells of {i * i}, and more than that</div></form></body>"
    out = main_texts(spark, [(h, page(i)) for h, page in (("bare", bare), ("meta", meta), ("form", form)) for i in range(12)])
    assert out[:12] == [f"Bare {i} tells of {i * i}" for i in range(12)]
    assert out[12:24] == [f"Meta {i} tells of {i * i}" for i in range(12)]
    assert out[24:] == [f"Form {i} tells of {i * i}, and more than that" for i in range(12)]


def test_short_texts_of_large_templates_and_small_hosts(spark):
    page = lambda i: "<body>" + "".join(f"<div><p>Template part {k}, the same all over</p></div>" for k in range(30)) + f"<section><p>Short {i}</p></section></body>"
    few = lambda i: f"<body><div>Follow us</div><section><p>Few {i}</p></section></body>"
    pages = [("large", page(i)) for i in range(8)] + [("few", few(i)) for i in range(3)] + [("copies", few(0))] * 6
    out = main_texts(spark, pages)
    assert out[:8] == [f"Short {i}" for i in range(8)] and out[8:11] == [f"Few {i}" for i in range(3)]
    assert set(out[11:]) == {"Follow us Few 0"}


# ---------------------------------------------------------------- 5


def test_line_cleaning_counts(docs, rows):
    out = found(line_cleaning.clean_by_lines(docs))
    for i, text, *_ in rows:
        w = words(text)
        grams = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {k + j for k in range(len(w) - 2) if grams[w[k], w[k + 1], w[k + 2]] > 1 for j in range(3)}
        lines = [x for x in (text or "").split("\n") if words(x)]
        r = out[i]
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(covered))
        assert r["n_dup_lines"] == len(lines) - len(set(lines)) and r["n_symbols"] == len(re.findall(r"[#*$%&|<>]", text or ""))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
        assert not (r["base_failed"] and r["kept"])


def test_line_verdicts(spark):
    good = " ".join(f"w{i}" for i in range(60))
    cases = {good: True, good + "\nhome | about | help": True, "home | about | help | more\n" + "a | b | c\n" * 20 + good: False, "STOP!! NOW!! " + good.replace(" ", "!! "): False}
    docs = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    out = found(line_cleaning.clean_by_lines(docs))
    assert [out[i]["kept"] for i in range(4)] == list(cases.values())
    assert out[1]["clean_text"] == good and out[1]["lost_words"] == 5


def test_long_texts_take_the_other_sort(spark, monkeypatch):
    text = " ".join(f"w{i % 37}" for i in range(100)) + " end"
    docs = spark.createDataFrame([(1, text), (2, "a b"), (3, None)], "doc_id long, text string")
    fast = line_cleaning.clean_by_lines(docs).collect()
    monkeypatch.setattr(line_cleaning, "PLACE_BITS", 3)
    assert line_cleaning.clean_by_lines(docs).collect() == fast


# ---------------------------------------------------------------- 6


def test_mixing_meets_targets(docs, rows):
    out = mixing.mix_sources(docs).collect()
    assert len(out) == len(rows)
    sizes = collections.Counter()
    for _, text, _, source, *_ in rows:
        sizes[source] += len(words(text))
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, left = {}, 1.5 * sum(sizes.values())
    free = set(names)
    while True:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * sizes[s]}
        if not over:
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        free -= over
    target |= {s: level * weight[s] for s in free}
    taken = collections.Counter()
    for r in out:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(target[r["source"]], abs=1e-5)
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"]
        taken[r["source"]] += r["taken"]
    for s in names:
        assert abs(taken[s] - target[s]) <= max(10, 0.02 * target[s])


def test_mixing_rates_solve_the_dual(docs):
    """Rates are min(2, exp(multiplier x size)) with one multiplier a source, and their words meet the target."""
    by_source = collections.defaultdict(list)
    for r in mixing.mix_sources(docs).collect():
        by_source[r["source"]].append(r)
    for group in by_source.values():
        target = group[0]["target"]
        assert sum(r["rate"] * r["size"] for r in group) == pytest.approx(target, rel=1e-6)
        lam = [math.log(r["rate"]) / r["size"] for r in group if r["size"] and r["rate"] < 2]
        assert not lam or np.ptp(lam) < 1e-9


def test_mixing_repeats_itself(docs):
    a, b = ([tuple(r) for r in mixing.mix_sources(x).select("doc_id", "size", "taken").orderBy("doc_id", "taken").collect()] for x in (docs, docs.repartition(3)))
    assert a == b


def test_repeated_rows_have_the_columns_of_documents(docs, none, rows):
    mixed = mixing.repeat_rows(docs)
    assert mixed.columns == docs.columns
    want = collections.Counter()
    for r in mixing.mix_sources(docs).collect():
        want[r["doc_id"]] += r["copies"]
    got = collections.Counter(r["doc_id"] for r in mixed.collect())
    assert +got == +want
    assert mixing.mix_sources(none).count() == mixing.repeat_rows(none).count() == 0


# ---------------------------------------------------------------- 7


def shingles(text):
    w = low(text).encode().split()
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def brute_components(texts):
    sets = {i: shingles(t) for i, t in texts.items()}
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return sets, {i: top(i) for i in sets}


@pytest.mark.parametrize("tight", [False, True])
def test_group_join_equals_brute_force(docs, rows, tight, monkeypatch):
    if tight:  # many buckets, blocks and groups; no merging before the search between components
        for name, value in (("BUCKET_TOKENS", 50), ("BLOCK_SETS", 2), ("GROUP_TOKENS", 60), ("MERGE_ROUNDS", 1), ("FLUSH_TOKENS", 100)):
            monkeypatch.setattr(group_join, name, value)
    sets, want = brute_components({r[0]: r[1] for r in rows})
    out = found(group_join.similar_components(docs))
    assert len(out) == len(want)
    for i, r in out.items():
        assert (r["n_shingles"], r["component_id"]) == (len(sets[i]), want[i])


def test_runs_longer_than_a_byte_go_on():
    values, lengths = np.array([4, 9, 2, 7]), np.array([1, 255, 256, 1000])
    names, counts = group_join.byte_runs(values, lengths)
    assert counts.dtype == np.uint8 and counts.min() > 0
    assert np.repeat(names, counts).tolist() == np.repeat(values, lengths).tolist()


def test_shared_counts_are_never_too_small(docs, rows):
    found_counts = {bytes(r["tag"]): r["shared"] for r in group_join.shared_counts(docs, "doc_id", 5, 3).collect()}
    assert all(len(t) == group_join.TAG_BYTES for t in found_counts)
    sets = [group_join.shingle_set(r[1]) for r in rows]
    classes = collections.defaultdict(set)
    for tokens in sets:
        for token in tokens.tolist():
            classes[token].add(group_join._class_key(tokens))
    for tokens in sets:
        truth = sum(len(classes[t]) > 1 for t in tokens.tolist())
        assert found_counts.get(group_join._class_tag(tokens), 0) >= truth


def test_group_join_at_the_limit(spark):
    """Overlap of exactly three quarters links; one token less does not."""
    w = [f"t{i}" for i in range(200)]
    base = w[:11]  # 7 shingles
    texts = {1: " ".join(base), 2: " ".join(w[:10]), 3: " ".join(w[100:107]), 4: " ".join(w[100:106] + ["z"]), 5: " ".join(w[100:108])}
    _, want = brute_components(texts)
    out = found(group_join.similar_components(spark.createDataFrame(list(texts.items()), "doc_id long, text string")))
    assert {i: r["component_id"] for i, r in out.items()} == want


def test_an_id_with_two_texts_keeps_the_links_of_both(spark):
    """Rows 2 and 3 are near one text of row 1 each; 5 and 6 carry one text twice; 7 stays alone."""
    rng = random.Random(17)
    text = lambda: [f"w{rng.randrange(900)}" for _ in range(60)]
    a, b, c = text(), text(), text()
    near = lambda w, k: " ".join([*w[:-k], *["z"] * k])
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, near(a, 2)), (3, near(b, 2)), (4, " ".join(b)), (5, " ".join(c)), (6, " ".join(c)), (6, near(c, 1)), (7, "alone")]
    out = group_join.similar_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(out) == len(rows)
    assert {r["doc_id"]: r["component_id"] for r in out} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 5, 7: 7}


def test_group_join_of_nothing_and_one_of_each(docs, none, rows):
    assert group_join.similar_components(none).count() == 0
    _, want = brute_components({r[0]: r[1] for r in rows})
    kept = [r["doc_id"] for r in group_join.one_of_each(docs).collect()]
    assert set(kept) == set(want.values()) and group_join.one_of_each(docs).columns == docs.columns


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 5), (200, 201), (202, 201), (7, 7)]
    out = {r["id"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {**{i: 1 for i in range(1, 61)}, 100: 1, 200: 200, 201: 200, 202: 200}


# ---------------------------------------------------------------- 8


def test_archives_round_trip(spark, tmp_path):
    long = "é" * 600
    rows = [(1, "http://a/", long), (2, "http://b/ x\r\ny", long), (3, None, long + "x"), (4, "u", "short"), (5, "u", "short"), (6, "u", None), (None, "u", "n"), (7, "u", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    manifest = zip_warc.write_archives(pages, str(tmp_path / "arc"), archive_bytes=200)
    out = found(zip_warc.read_archives(manifest), "page_id")
    assert len(out) == len(rows) and manifest.count() > 3
    for i, url, body in rows:
        raw, r = (body or "").encode(), out[i]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(raw), hashlib.sha1(raw).hexdigest())
        assert (r["record_type"], r["refers_to"]) == (("revisit", 2) if i == 1 else ("response", None))
        assert r["payload"] == (None if i == 1 else raw) and r["url"] == (None if url is None else " ".join(url.split()))
    assert zip_warc.round_trip(pages.limit(0)).count() == 0


def test_one_record_by_range_and_broken_archives(spark, tmp_path):
    import pyarrow.fs as pafs

    pages = spark.createDataFrame([(i, "u", f"page {i}") for i in range(50)], "page_id long, url string, html string").coalesce(1)
    path = zip_warc.write_archives(pages, str(tmp_path / "arc")).first()["path"]
    fs = pafs.LocalFileSystem()
    assert [r["payload"] for r in zip_warc.read_archive(fs, path, wanted={17})] == [b"page 17"]
    raw = open(path, "rb").read()
    for bad in (raw[: len(raw) // 2], raw.replace(b"PK\x01\x02", b"PK\x09\x09")):
        (tmp_path / "bad.zip").write_bytes(bad)
        with pytest.raises(ValueError):
            list(zip_warc.read_archive(fs, str(tmp_path / "bad.zip")))


# ---------------------------------------------------------------- 9


def test_benchmark_hits(spark, docs, rows):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    texts = {r[0]: r[1] for r in rows}
    some = pattern.findall(low(texts[8]))
    items = [(1, " ".join(some[5:30])), (2, "word"), (3, None), (4, "--"), (12, "a, b! c"), (13, " ".join(some[5:18])), (14, "never seen words here at all")]
    windows = collections.defaultdict(set)
    for i, t in items:
        w = pattern.findall(low(t))
        n = min(10, len(w))
        for k in range(len(w) - n + 1) if w else ():
            windows[tuple(w[k : k + n])].add(str(i))
    out = found(positional_index.find_benchmark(docs, spark.createDataFrame(items, "item_id long, text string")))
    assert any(r["contaminated"] for r in out.values())
    for i, t in texts.items():
        w = pattern.findall(low(t))
        hit, names = set(), set()
        for window, owners in windows.items():
            n = len(window)
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) == window:
                    hit |= set(range(k, k + n))
                    names |= owners
        r = out[i]
        digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == (len(w), len(hit), len(names), digest, bool(hit))


def test_proximity_and_empty_sides(spark, docs, none, rows):
    near = spark.createDataFrame([(1, "alpha x beta y gamma"), (2, "alpha " + "z " * 40 + "beta gamma")], "doc_id long, text string")
    windows = positional_index.test_windows(spark.createDataFrame([(9, "alpha beta gamma")], "item_id long, text string"))
    index = positional_index.build_index(near, "doc_id", positional_index.term_bitmap(windows))
    hits = {r["doc_id"]: len(r["found"]) for r in positional_index.search_index(index, windows, slack=3).collect()}
    assert hits == {1: 1, 2: 0}
    items = spark.createDataFrame([], "item_id long, text string")
    assert not any(r["contaminated"] for r in positional_index.find_benchmark(docs, items).collect())
    assert positional_index.find_benchmark(none, items).count() == 0
    assert positional_index.drop_contaminated(docs, items).count() == len(rows)


def test_shards_of_the_index_do_not_change_hits(spark, docs, monkeypatch):
    items = spark.createDataFrame([(1, "x x x x x x x x x x x")], "item_id long, text string")
    before = sorted(map(tuple, positional_index.find_benchmark(docs, items).collect()))
    monkeypatch.setattr(positional_index.build_index, "__defaults__", (positional_index.WINDOW, 50))
    assert sorted(map(tuple, positional_index.find_benchmark(docs, items).collect())) == before


# ---------------------------------------------------------------- 10


def test_class_model_counts_and_probabilities(docs, rows):
    unique = docs.dropDuplicates(["doc_id"])
    out = found(class_lm.score_documents(unique, frequent_limit=40, classes=6))
    texts = {r[0]: low(r[1]).encode().split() for r in rows}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in texts}
    counts = collections.Counter()
    for i, w in texts.items():
        if not held[i]:
            counts.update(w)
            counts["END"] += 1
    n, v = sum(counts.values()), len(counts)
    for i, w in texts.items():
        tokens = [*w, "END"]
        base = sum(math.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in tokens)
        r = out[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(tokens), sum(counts[t] > 0 for t in tokens), n, held[i])
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["score"] < 0
    dear = [r for i, r in out.items() if len(texts[i]) > 20]
    assert sum(r["score"] for r in dear) > sum(r["base_score"] for r in dear)


def test_exchange_raises_the_class_likelihood():
    rng = np.random.default_rng(3)
    kinds = np.repeat([0, 1, 2], 10)
    bigrams = np.zeros((31, 31))
    for a in range(30):
        for b in range(30):
            if (kinds[a] + 1) % 3 == kinds[b]:
                bigrams[a, b] = rng.integers(5, 30)
    of = class_lm.exchange_classes(bigrams, 4)
    assert of[30] == 3
    groups = [set(of[:30][kinds == k]) for k in range(3)]
    assert all(len(g) == 1 for g in groups) and len(set.union(*groups)) == 3


def test_class_probabilities_sum_to_one(docs):
    """Over all known words and one unknown per class, the next-word probabilities add up."""
    model = class_lm.class_model(docs.dropDuplicates(["doc_id"]), 4, 30, 5)
    assert np.allclose((10 ** model["step"]).sum(1), 1)


def test_class_model_of_nothing(none, spark):
    assert class_lm.score_documents(none).count() == 0
    held = spark.createDataFrame([(i, "a b") for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0], "doc_id long, text string")
    out = class_lm.score_documents(held).collect()
    assert out and all(r["train_tokens"] == 0 and r["n_known"] == 0 for r in out)


def test_rare_words_take_the_class_of_their_neighbours(spark):
    """Rare words of one ending part into those after "le" and those after "run"."""
    rng = random.Random(4)
    pick = lambda kind: f"{kind}{min(rng.randrange(80), rng.choice([1, 2, 80]))}xyz"
    rows = [(1, " ".join(w for _ in range(20) for w in ("le", pick("n"), "est", "run", pick("v"), "now"))) for _ in range(60)]
    model = class_lm.class_model(spark.createDataFrame(rows, "doc_id long, text string"), 4, 8, 8)
    of = {}
    for r in model["vocabulary"].collect():
        of |= dict(zip(np.frombuffer(r["keys"], np.uint64).tolist(), np.frombuffer(r["classes"], np.uint8).tolist(), strict=True))
    counts = collections.Counter(w for _, text in rows for w in text.split())
    rare = [w for w, c in counts.items() if w.endswith("xyz") and class_lm.LEAST_COUNT <= c < 30]
    nouns, verbs = ({of[int(class_lm.word_keys(w)[0])] for w in rare if w[0] == kind} for kind in "nv")
    assert len(rare) > 80 and nouns and verbs and not nouns & verbs


def test_gains_are_differences_of_the_likelihood():
    rng = np.random.default_rng(8)
    of, text = rng.integers(0, 3, 12), rng.integers(0, 12, 900)
    text = text[np.concatenate(([True], text[1:] != text[:-1]))]  # a word beside itself moves both sides at once
    text = np.concatenate((text, [13 if text[0] == text[-1] else text[0]]))
    of = np.concatenate((of, [0, 0]))

    def likelihood(of):
        joint = np.zeros((4, 4))
        np.add.at(joint, (of[text[:-1]], of[text[1:]]), 1)
        return class_lm._plogp(joint).sum() - class_lm._plogp(joint.sum(1)).sum() - class_lm._plogp(joint.sum(0)).sum(), joint

    joint = likelihood(of)[1]
    u = next(w for w in range(12) if w not in (text[0], text[-1]))  # with as many words before as after
    table = np.zeros((1, 8))
    np.add.at(table[0], of[text[:-1][text[1:] == u]], 1)
    np.add.at(table[0], 4 + of[text[1:][text[:-1] == u]], 1)
    gains = class_lm.class_gains(table, of[[u]], joint)[0]
    want = np.array([likelihood(np.where(np.arange(14) == u, c, of))[0] for c in range(4)])
    assert gains - gains[of[u]] == pytest.approx(want - want[of[u]], abs=1e-6)


def test_class_scores_equal_a_plain_recomputation(docs, rows):
    """Class bigrams, sums and scores follow from the classes of the words alone, whatever the buckets and chunks."""
    unique = docs.dropDuplicates(["doc_id"])
    texts = {r[0]: low(r[1]).encode().split() for r in rows}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in texts}
    train = unique.filter(~unique.doc_id.isin([i for i in texts if held[i]]))
    model = class_lm.class_model(train, 3, 40, 6)
    of, counts = {}, {}
    for r in model["vocabulary"].collect():
        keys = np.frombuffer(r["keys"], np.uint64)
        of |= dict(zip(keys.tolist(), class_lm._classes_of(keys, r["classes"], model).tolist(), strict=True))
        counts |= dict(zip(keys.tolist(), np.frombuffer(r["counts"], np.int64).tolist(), strict=True))

    def path_of(words):
        keys = class_lm.word_keys(b" ".join(words).decode())
        return keys.tolist(), [5, *(of.get(int(k), int(model["endings"][int(k) >> 56])) for k in keys), 5]

    joint = np.zeros((6, 6))
    for i, words in texts.items():
        if not held[i]:
            path = path_of(words)[1]
            np.add.at(joint, (path[:-1], path[1:]), 1)
    assert np.array_equal(joint, model["joint"])
    ends = sum(not h for h in held.values())
    n = [sum(counts[k] for k in of if of[k] == c) for c in range(5)] + [ends]
    v = [sum(of[k] == c for k in of) for c in range(5)] + [1]
    out = found(class_lm.score_documents(unique, frequent_limit=40, classes=6))
    for i, words in texts.items():
        keys, path = path_of(words)
        token_counts = [counts.get(k, 0) for k in keys] + [ends]
        want = 0.0
        for a, b, c in zip(path[:-1], path[1:], token_counts, strict=True):
            want += math.log10((joint[a, b] + 0.1) / (joint[a].sum() + 0.6)) + math.log10((c + 0.1) / (n[b] + 0.1 * (v[b] + 1)))
        assert out[i]["score"] == pytest.approx(want, rel=1e-9)


def test_machine_learns_pairs_of_words_that_tell_nothing_alone(spark):
    """Exactly one of two words makes a text toxic: each alone has the share of all texts, only the pair tells."""
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(1200):
        a, b = i % 2, i // 2 % 2
        words = [f"w{rng.randrange(30)}" for _ in range(6)] + ["grolt"] * a + ["mib"] * b
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, a ^ b))
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    out = [r for r in factorization.toxicity(docs, known).collect() if r["held_out"]]
    right = sum(r["predicted"] == labels[r["doc_id"]][1] for r in out)
    assert len(out) > 300 and right >= 0.98 * len(out)


def test_pair_search_equals_plain_counting(spark):
    rng = random.Random(2)
    words = [np.array([rng.randrange(12) for _ in range(rng.randrange(0, 30))], np.int32) for _ in range(300)]
    rows = [(int(3 in w and 5 in w), bytearray(w.tobytes())) for w in words]
    got = factorization.select_pairs(spark.createDataFrame(rows, "y int, words binary"), np.array([7]), min_chi2=20.0)
    distinct = {(y, bytes(w)) for y, w in rows if len(w) > 4}
    n, pos, count = len(distinct), sum(y for y, _ in distinct), collections.defaultdict(lambda: [0, 0])
    for y, body in distinct:
        w = np.frombuffer(body, np.int32).tolist()
        for pair in {tuple(sorted((w[i], w[j]))) for i in range(len(w)) for j in range(i + 1, min(i + 9, len(w))) if w[i] != w[j] and 7 not in (w[i], w[j])}:
            count[pair][0] += 1
            count[pair][1] += y
    chi2 = {p: n * (h * n - d * pos) ** 2 / (d * (n - d) * pos * (n - pos)) for p, (d, h) in count.items() if 3 <= d < n}
    want = {t for p, x in chi2.items() if x >= 20.0 for t in p}
    assert want and set(got.tolist()) == want
