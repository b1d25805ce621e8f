"""Merkle manifest, license scan and periodic runs against brute force, and against SQL where there is any."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import pytest
from oracle_compare import DATA, compare, duck

from loanvane.llm import license_scan, manifest, periodic_runs
from loanvane.llm.license_templates import TEMPLATES
from loanvane.llm.oracles import ORACLES
from loanvane.llm.queries import QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long, tree string, place long, digest string, path string, h long, runs string, spans string"
EXTRA = ("t", 5, "d", "p", 9, "r", "s")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    words = ["a", "b", "c", "é", "MIT", "license"]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 40))) for _ in range(90)]
    texts += [None, "", " \n\t ", "a " * 5000, "x", "a b\n" * 40, "Released under the MIT License."]
    out = [(i, t, [None, "", "en", "fr", "en"][i % 5], "s" if i % 3 else None, len(t or "") if i % 4 else None, *EXTRA) for i, t in enumerate(texts)]
    return [*out, out[2], out[2], (7, "another text", "fr", "s", 3, *EXTRA), (None, "no key", "en", "s", 3, *EXTRA), (None, None, None, None, None, *EXTRA)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(5).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def con():
    return duck("0.01")


@pytest.mark.parametrize("name", ["op11_merkle_manifest", "op12_license_scan"])
def test_query_equals_sql(spark, con, name):
    found, wanted = QUERIES[name](spark, str(DATA / "sf0.01")).toPandas(), con.execute(ORACLES[name]).df()
    counted = [c for c in ("first_word", "last_word") if c in found]
    assert len(found) == 1000
    assert compare(found.astype(dict.fromkeys(counted, "Int64")), wanted.astype(dict.fromkeys(counted, "Int64"))) == ""


# ---------------------------------------------------------------- manifest


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(doc_id, source, lang, n_chars, text):
    return sha("".join(map(field, (doc_id, source, lang, n_chars, text))))


def climb(level, arity):
    """Root of a list of digests, and for each of them its siblings by level as (before, after)."""
    paths, at = [[] for _ in level], list(range(len(level)))
    while len(level) > 1:
        for path, i in zip(paths, at):
            run = level[i // arity * arity : (i // arity + 1) * arity]
            path.append((run[: i % arity], run[i % arity + 1 :]))
        level, at = [sha("".join(level[i : i + arity])) for i in range(0, len(level), arity)], [i // arity for i in at]
    return level[0], paths


def brute_manifest(rows, arity=2):
    trees = {}
    for r in rows:
        trees.setdefault(r[2], []).append(r)
    order = sorted(trees, key=lambda g: (g is not None, (g or "").encode()))
    roots, low = [], []
    for g in order:
        mine = sorted(trees[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r[0], r[3], r[2], r[4], r[1])))
        hashes = [leaf(r[0], r[3], r[2], r[4], r[1]) for r in mine]
        root, paths = climb(hashes, arity)
        roots.append(root)
        low.append(list(zip(mine, hashes, paths)))
    root, high = climb(roots, arity)
    out = []
    for subroot, group, top in zip(roots, low, high):
        for r, own, path in group:
            path = path + top
            changed = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            folded = leaf(r[0], r[3], r[2], r[4] + 1, r[1]) if changed else own
            for before, after in path:
                folded = sha("".join([*before, folded, *after]))
            out.append((r[0], own, subroot, root, sha("".join(x for b, a in path for x in b + a)), folded, folded == root))
    return out


@pytest.mark.parametrize("partitions_", [1, 7])
def test_manifest_equals_brute_force(docs, rows, partitions, partitions_):
    partitions(partitions_)
    found = [tuple(r) for r in manifest.tampered_round_trip(docs).collect()]
    assert sorted(map(repr, found)) == sorted(map(repr, brute_manifest(rows)))
    assert {r[-1] for r in found} == {True, False}


@pytest.mark.parametrize("arity", [3, 4])
def test_wider_runs(docs, rows, arity):
    made = manifest.build_manifest(docs, "doc_id", "lang", manifest.COLUMNS, arity)
    found = manifest.verify(made.proofs(), made.root, manifest.F.col("leaf"))
    found = found.select("leaf_key", "leaf", "subroot", manifest.path_digest(manifest.F.col("path")).alias("proof"), "verified").collect()
    want = brute_manifest(rows, arity)
    assert made.root == want[0][3]
    assert sorted(map(repr, [(r[0], r[1], r[2], r[3]) for r in found])) == sorted(map(repr, [(r[0], r[1], r[2], r[4]) for r in want]))
    assert all(r["verified"] for r in found)
    nodes = made.nodes()
    assert nodes.filter("level = 0 and tree <> 'root'").count() == len(rows)


def test_manifest_of_little(spark, none):
    assert manifest.tampered_round_trip(none).count() == 0
    assert manifest.build_manifest(none, "doc_id", "lang", manifest.COLUMNS).root is None
    one = spark.createDataFrame([(1, "x", "en", "s", 1, *EXTRA)], DOCS)
    row = manifest.tampered_round_trip(one).first()
    assert row["leaf"] == row["subroot"] == row["root"] == leaf(1, "s", "en", 1, "x") and row["proof_sha256"] == sha("")


def test_copies_of_one_row_share_the_work(spark):
    """Rows alike in every column have one digest and go to several ranges."""
    rows = [(5, "same", "en", "s", 4, *EXTRA)] * 300
    staged = manifest.stage(spark.createDataFrame(rows, DOCS).repartition(6).selectExpr("lang as tree", "doc_id as leaf_key"), "test-copies")
    placed = manifest.in_order(staged, ["leaf_key"], "test-order")
    assert sorted(r["place"] for r in placed.collect()) == list(range(300))
    assert placed.select(manifest.F.spark_partition_id()).distinct().count() > 1 or placed.rdd.getNumPartitions() == 1


# ---------------------------------------------------------------- licenses


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute_licenses(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text))
    joined = " " + " ".join(words) + " "
    places, named = [], set()
    for phrase, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")):
        n = len(phrase.split())
        at = [i for i in range(len(words)) if words[i : i + n] == phrase.split()]
        places += at
        named |= {label} if at else set()
    accepted = {label for label, markup in TEMPLATES if re.search(license_scan.template_pattern(markup), joined)}
    score = 1.0 if accepted else 0.5 if places else 0.0
    join = lambda s: ",".join(sorted(s))
    return len(words), len(places), min(places, default=None), max(places, default=None), join(named), join(named | accepted), score


def filled(markup, rng, drop=None):
    """A text of a template: optional parts in or out, gaps of any length; ``drop`` leaves out that mandatory word."""
    count = [0]

    def write(parts):
        for p in parts:
            if isinstance(p, license_scan.Gap):
                yield from (f"w{rng.randrange(99)}" for _ in range(rng.randint(0, p.most)))
            elif isinstance(p, license_scan.Optional):
                yield from write(p.parts) if rng.random() < 0.5 else ()
            else:
                count[0] += 1
                if count[0] - 1 != drop:
                    yield p.decode()

    return " ".join(write(license_scan.parse_template(markup)))


def mandatory(markup):
    return [p for p in license_scan.parse_template(markup) if isinstance(p, bytes)]


@pytest.fixture(scope="module")
def notices():
    rng = random.Random(3)
    out = [None, "", "¡", "MIT licensed", "the MIT LICENSE, mit-license; mit license", "Permission is hereby granted, " * 30, "mit\x00license mit licensé"]
    for label, markup in TEMPLATES:
        for _ in range(3):
            out.append("Some code.\n/* " + filled(markup, rng) + " */ rest of it")
        out.append(filled(markup, rng, drop=rng.randrange(len(mandatory(markup)))))
    return [*out, "word " * 20000 + filled(TEMPLATES[0][1], rng), " ".join(filled(m, rng) for _, m in TEMPLATES)]


def test_licenses_equal_brute_force(spark, notices):
    rows = [(i, t, None, None, None, *EXTRA) for i, t in enumerate(notices)]
    spans = license_scan.license_spans(spark.createDataFrame([*rows, rows[4]], DOCS).repartition(4))
    found = license_scan.license_labels(spans).collect()
    assert len(found) == len(rows) + 1
    for r in found:
        assert tuple(r)[1:] == brute_licenses(notices[r["doc_id"]]), notices[r["doc_id"]]


def test_every_template_accepts_its_texts_and_no_text_with_a_word_missing():
    rng = random.Random(6)
    for label, markup in TEMPLATES:
        compiled = [license_scan.Template.compile(label, markup)]
        n = len(mandatory(markup))
        for _ in range(5):
            words = license_scan.scan_words(filled(markup, rng))
            spans = license_scan.scan_text(words, compiled, [])
            assert any(s[1] == label for s in spans)
        for drop in rng.sample(range(n), min(n, 12)):
            parts = [p for p in license_scan.parse_template(markup)]
            parts.remove(mandatory(markup)[drop])
            words = [w for p in parts for w in ([p] if isinstance(p, bytes) else [])]
            if words != mandatory(markup):
                assert not license_scan.scan_text(words, compiled, []), (label, drop)


def test_spans_cover_optional_wording_before_the_anchor():
    t = [license_scan.Template.compile("x", "<<beginOptional>>copyright <<var;max=3>><<endOptional>> all rights <<beginOptional>>are<<endOptional>> reserved")]
    scan = lambda text: license_scan.scan_text(license_scan.scan_words(text), t, [])
    assert scan("z Copyright 2020 me. All rights reserved z") == [("template", "x", 1, 6)]
    assert scan("z all rights are reserved") == [("template", "x", 1, 4)]
    assert scan("all rights not reserved") == []


def test_bad_markup():
    for markup in ("<<beginOptional>> a", "a <<endOptional>>", "a <<odd>>", "<<var;max=3>>"):
        with pytest.raises(ValueError):
            license_scan.Template.compile("x", markup)


def test_licenses_of_nothing(none):
    assert license_scan.license_labels(license_scan.license_spans(none)).count() == 0


# ---------------------------------------------------------------- runs


def brute_runs(w):
    """Every maximal repetition of at least six words and four smallest periods, by comparing words."""
    out, n = set(), len(w)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j + q - i
            if length >= max(6, 4 * q) and not any(all(w[k] == w[k + d] for k in range(i, i + length - d)) for d in range(1, q)):
                out.add((i, length, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def planted(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def brute_digest(doc_id, text):
    w = planted(doc_id, text)
    runs = brute_runs(w)
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    kept = [x for i, x in enumerate(w) if not any(s + q <= i < s + n for s, n, q in runs)]
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    top = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *top, sha(lines), sha(" ".join(kept)))


def test_runs_equal_brute_force():
    rng = random.Random(2)
    for _ in range(3000):
        n, k = rng.randint(0, 70), rng.choice([1, 2, 2, 3, 6, 50])
        w = [str(rng.randrange(k)).encode() for _ in range(n)]
        for _ in range(rng.randint(0, 3) if n else 0):
            p, a = rng.randint(1, 9), rng.randrange(n)
            z = rng.randint(a, n)
            w = [w[a + (i - a) % p] if a <= i < z and a + (i - a) % p < n else w[i] for i in range(n)]
        assert periodic_runs.text_runs(w) == brute_runs(w), w


def test_common_extensions_and_tree():
    rng = random.Random(9)
    for _ in range(200):
        s = periodic_runs.np.array([rng.randint(1, 3) for _ in range(rng.randint(1, 30))])
        n = len(s)
        tree = periodic_runs.CommonExtension(s)
        suffixes = sorted(range(n + 1), key=lambda i: s[i:].tolist())
        assert tree.rank.tolist() == [suffixes.index(i) for i in range(n + 1)]
        pairs = periodic_runs.np.array([(i, j) for i in range(n + 1) for j in range(n + 1) if i != j])
        want = [next((d for d in range(n) if max(i, j) + d >= n or s[i + d] != s[j + d]), 0) for i, j in pairs.tolist()]
        assert tree.common(pairs[:, 0], pairs[:, 1]).tolist() == want


def test_runs_query_equals_brute_force(spark, rows):
    rng = random.Random(8)
    more = [(i, " ".join(rng.choices("abcdefgh", k=rng.randint(0, 120))), None, None, None, *EXTRA) for i in range(1000, 1150)]
    table = [*[r for r in rows if len(r[1] or "") < 5000], *more]
    docs = spark.createDataFrame(table, DOCS).repartition(6)
    found = periodic_runs.run_digests(periodic_runs.periodic_runs(periodic_runs.with_planted_periods(docs))).collect()
    assert sorted(map(repr, map(tuple, found))) == sorted(repr(brute_digest(r[0], r[1])) for r in table)
    assert sum(zlib.crc32(str(r[0]).encode()) % 10 == 0 for r in table) > 10


def test_runs_of_long_texts_and_of_nothing(spark, none):
    rng = random.Random(1)
    base = [f"w{rng.randrange(500)}" for _ in range(3000)]
    text = " ".join(["lead"] + (base * 6)[:14000] + ["tail"] * 9)
    one = spark.createDataFrame([(1, text, None, None, None, *EXTRA)], DOCS)
    row = periodic_runs.periodic_runs(one).first()
    assert [tuple(r) for r in row["runs"]] == [(1, 14000, 3000), (14001, 9, 1)]
    assert row["collapsed"] == " ".join(["lead", *base, "tail"]) and row["n_words"] == 14010
    assert periodic_runs.run_digests(periodic_runs.periodic_runs(periodic_runs.with_planted_periods(none))).count() == 0
