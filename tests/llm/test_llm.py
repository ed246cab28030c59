"""The corpus operators against brute force on small tables, with nulls, empty and long texts, ties and repeated rows."""

import collections
import hashlib
import re
import tracemalloc
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from shardlore.llm import chat, components, decontaminate, embeddings, licenses, mixing, neardup, registry, repeats, secrets, sharding, toxicity

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
#: Nulls in every column, empty and odd texts, repeated rows, and columns that clash with names used inside.
EXTRA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, key string, shard string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None, "s", None, None, "k", "x") for i, t in rows], EXTRA)


@pytest.fixture(scope="module")
def awkward(spark):
    long = " ".join(f"w{i % 700}" for i in range(30_000))
    base = " ".join(f"base{i} tail" for i in range(60))
    rows = [(1, None), (2, ""), (3, "   "), (None, base), (None, None), (4, base), (4, base), (5, base.replace("base7 ", "other ")), (6, long), (7, "é ß 漢字 " * 40), (8, "One two")]
    return frame(spark, rows)


@pytest.fixture(scope="module")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


def empty(df):
    return df.limit(0)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, small, duck, same, name):
    assert same(registry.queries()[name](spark, small).toPandas(), duck.execute(registry.oracle_sql()[name]).fetchdf())


# Decontamination


def test_windows(spark):
    items = spark.createDataFrame([(1, "a b c d e f g h i j k"), (2, "short one"), (3, None), (4, "!!"), (None, "null id here"), (2, "short one"), (10, "a b c d e f g h i j")], "item_id long, text string")
    text = "x A b c d e f g h i j, k y short one short\none null id here"
    got = decontaminate.report(frame(spark, [(1, text), (2, "a b c"), (3, None), (None, "short one")]), items).collect()
    found = {r.doc_id: r for r in got}
    assert (found[1].n_words, found[1].n_hit, found[1].n_items) == (20, 18, 3)
    assert found[1].items_sha256 == hashlib.sha256(b"1,10,2").hexdigest()
    assert (found[2].n_hit, found[3].n_words, found[None].contaminated) == (0, 0, True)


def test_blocks_agree(spark, docs, small, monkeypatch):
    items = spark.read.parquet(f"{small}/benchmark.parquet")
    one = sorted(map(str, decontaminate.report(docs, items).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 3000)
    assert sorted(map(str, decontaminate.report(docs, items).collect())) == one


def test_proximity(spark):
    index = decontaminate.build_index(frame(spark, [(1, "red x x blue"), (2, "red " + "x " * 30 + "blue"), (3, "blue red")]))
    ids, phrases = next(decontaminate.blocks(spark.createDataFrame([(1, "red blue")], "item_id long, text string"), 10))
    near = decontaminate.find(index, ids, phrases, distance=4).filter(F.size("item_ids") > 0)
    assert sorted(r.doc_id for r in near.collect()) == [1, 3]


def test_decontaminate_awkward(spark, awkward):
    items = spark.createDataFrame([(1, "base1 tail base2 tail base3 tail base4 tail base5 tail")], "item_id long, text string")
    left = decontaminate.decide(awkward, items)
    assert left.columns == awkward.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == ["1", "2", "3", "6", "7", "8", "None"]
    clash = awkward.withColumns({"leaked_text": F.lit(1), "spans": F.lit(2)})
    assert decontaminate.decide(clash, items).columns == clash.columns and decontaminate.decide(clash, items).count() == 7
    assert decontaminate.report(empty(awkward), items).count() == 0
    assert decontaminate.report(awkward, empty(items)).filter("contaminated").count() == 0


# Licences and secrets


def test_licenses(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    rows += [(-1, None), (-2, ""), (None, "CC by, cc BY"), (-3, "All Rights\nReserved " * 500), (-4, licenses.TEMPLATES[13].words + " " + "x " * 50), (-5, "the mit"), (-5, "general public license")]
    expected = collections.Counter()
    for i, t in rows:
        w, places, labels = WORDS.findall((t or "").translate(LOWER)), [], set()
        for phrase, label in licenses.BASE:
            p = phrase.split()
            found = [k for k in range(len(w)) if w[k : k + len(p)] == p]
            places += found
            labels |= {label} if found else set()
        expected[i, len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))] += 1
    got = licenses.scan(frame(spark, rows)).collect()
    assert collections.Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == expected
    assert all(0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in got)
    assert next(r for r in got if r.doc_id == -4).labels == "mit"
    assert licenses.scan(empty(docs)).count() == 0


def test_license_labels(spark, docs):
    """Labels and scores against sliding every template over every text."""
    rows = [(r.doc_id, r.text) for r in docs.filter("doc_id < 120").collect()]
    made = " ".join(f"word{i}" for i in range(30))
    for k, t in enumerate(licenses.TEMPLATES):
        words = t.words.split()
        rows += [(1000 + k, f"{made} {t.words.upper()} {made}"), (2000 + k, " ".join([*words[:2], "other", *words[3:]])), (3000 + k, " ".join(words[: len(words) // 2]) + " " + made)]
    rows += [(4000, "licensed under the mit license or licensed under the apache license version 2.0"), (4001, "released under the mit license, licensed under the mit license")]
    book = licenses.Book()
    df = frame(spark, rows)
    book.weigh(*licenses.frequencies(df, book))
    got = {r.doc_id: r for r in licenses.scan(df).collect()}
    reported = 0
    for i, text in rows:
        w = WORDS.findall(text.translate(LOWER))
        labels = set(filter(None, got[i].base_labels.split(",")))
        best = 1.0 if labels else 0.0
        for t in book.templates:
            words = licenses.split(t.words)
            total = sum(book.idf[book.number[x]] for x in words)
            share = max((sum(book.idf[book.number[x]] for q, x in enumerate(words) if 0 <= b + q < len(w) and w[b + q] == x) / total for b in range(1 - len(words), len(w))), default=0)
            keys = all(any(w[b : b + len(k)] == k for b in range(len(w))) for k in map(licenses.split, t.keys))
            assert abs(share - licenses.LEAST) > 1e-6
            if share >= licenses.LEAST and keys:
                labels.add(t.label)
                best = max(best, share)
        assert got[i].labels == ",".join(sorted(labels)), i
        assert best - 1e-9 <= got[i].score <= max(best, 0.5) + 1e-9
        reported += len(labels)
    assert reported > 60


BASE = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m.group(2)) >= 8),
    ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m.group()) >= 16),
    ("hex", re.compile("[0-9a-f]+"), lambda m: len(m.group()) >= 32),
)


def test_secrets(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    rows += [(-1, None), (-2, ""), (None, "é Api_Key : 'abcdefgh12'"), (-3, "AKIA" + "A1" * 8), (-4, "aAKIAX token=short TOKEN=longer-enough"), (-5, "0" * 31 + "g" + "a" * 40)]
    rows += [(-6, "ghp_" + "a" * 40), (-7, "x" * 5000 + "password=" + "b" * 5000), (-7, "PASSWD=\"x/y+z.12=\""), (-8, "-----BEGIN RSA PRIVATE KEY-----"), (-9, "https://bob:hunter22@host/x")]
    got = secrets.report(frame(spark, rows)).collect()
    expected = collections.Counter()
    for i, t in rows:
        spans = sorted((m.start(), k, m.end()) for k, (_, p, ok) in enumerate(BASE) for m in p.finditer(t or "") if ok(m))
        text = ",".join(f"{BASE[k][0]}:{a}:{b}" for a, k, b in spans)
        expected[(i, hashlib.sha256(text.encode()).hexdigest(), *(sum(k == n for _, k, _ in spans) for n in range(3)))] += 1
    assert collections.Counter((r.doc_id, r.base_sha256, r.n_assign, r.n_access, r.n_hex) for r in got) == expected
    found = {r.doc_id: r.spans for r in got}
    assert "github:0:44" in found[-6] and "private_key:0:31" in found[-8] and "url_login" in found[-9]


def test_index_finds_what_scanning_finds():
    texts = ["password = abcdefgh", "pass word", "API_KEY=12345678", "apikey", "xoxb-1234567890", "eyJabcdefghi.eyJabcdefghi.abcdefghi", "AKIA", "s://a:bcd@"]
    for rule in secrets.RULES:
        query = secrets.trigram_query(rule.pattern)
        for t in texts:
            if re.search(rule.pattern, t) and query is not None:

                def holds(q, low=t.lower()):
                    return q in low if isinstance(q, str) else (all if q[0] == "and" else any)(map(holds, q[1:]))

                assert holds(query), (rule.kind, t)
    assert secrets.trigram_query("[0-9a-f]+") is None
    assert secrets.trigram_query("abc(d|e)f") == ("or", ("and", "abc", "bcd", "cdf"), ("and", "abc", "bce", "cef"))


# Embeddings


def test_embeddings(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 32))
    rows = [(i, (centres[i % 6] + rng.normal(size=32) * 0.2 * (i % 4)).tolist(), i % 2) for i in range(300)]
    rows += [(1000 + i, rows[0][1], 0) for i in range(5)]
    odd = [None, [], [0.0] * 32, [float("nan")] * 32, [1.0] * 31 + [float("inf")], [1.0] * 31 + [None], [1.0] * 5]
    rows += [(2000 + i, v, 0) for i, v in enumerate(odd)] + [(3000, rows[0][1], None), (None, rows[0][1], 0)]
    vectors = spark.createDataFrame([(*r, "c") for r in rows], "vec_id long, embedding array<double>, label int, rep string")
    got = {r.vec_id: r for r in embeddings.near_duplicates(vectors).collect()}
    good = [(i, np.array(v), label) for i, v, label in rows if i is not None and label is not None and i < 2000]
    links = collections.defaultdict(set)
    for i, v, a in good:
        for j, w, b in good:
            if i < j and a == b and v @ w / np.sqrt((v @ v) * (w @ w)) >= embeddings.COSINE:
                links[i].add(j)
                links[j].add(i)

    def component(i):
        seen, todo = {i}, [i]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        return min(seen)

    assert len(got) == len(rows)
    total = sum(len(x) for x in links.values())
    found = sum(got[i].n_links for i, _, _ in good)
    assert total > 1000 and 0.99 * total <= found <= total
    assert sum(got[i].component_id != component(i) for i, _, _ in good) <= 2
    assert all(got[2000 + k].n_links == 0 and got[2000 + k].kept for k in range(len(odd)))
    assert got[3000].n_links == 0 and got[None].component_id is None and got[None].kept
    assert embeddings.near_duplicates(empty(vectors)).count() == 0
    assert embeddings.miss() < 0.001


def test_collisions():
    """Bitmaps of sorted windows count what comparing each pair counts; few unrelated pairs pass, those at the bound do."""
    rng = np.random.default_rng(6)
    x, y = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (rng.normal(size=(150, 48)), rng.normal(size=(1000, 48))))
    noise = rng.normal(size=(100, 48))
    noise -= (noise * x[:100]).sum(axis=1, keepdims=True) * x[:100]
    y[:100] = embeddings.COSINE * x[:100] + np.sqrt(1 - embeddings.COSINE**2) * noise / np.linalg.norm(noise, axis=1, keepdims=True)
    px, py = (v @ embeddings.directions_of(48) for v in (x, y))
    counts = (np.abs(px[:, None] - py[None]) <= embeddings.WIDTH).sum(axis=2)
    i, j = embeddings.collide(x, y)
    assert set(zip(i.tolist(), j.tolist())) == set(zip(*(a.tolist() for a in np.nonzero(counts >= embeddings.LEAST))))
    assert sum(i == j) >= 99 and len(i) < 0.002 * counts.size


# Chats


def test_chat(spark):
    rows = [(1, 2, "assistant", "two"), (1, 1, "user", "one <|im_end|>"), (1, 3, "assistant", "<|"), (1, 3, "assistant", "<|"), (1, 4, "a\nb<|nl|>", "x|"), (2, 1, None, None), (None, None, "assistant", "é"), (3, 1, "user", "<|im_end|>\n<|im_part|>" * 200)]
    turns = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    got = {r.conv_id: r for r in chat.report(turns).collect()}
    for conv in (1, 2, 3, None):
        mine = sorted(((r[1] is not None, r[1] or 0), r[2] or "", r[3] or "") for r in rows if r[0] == conv)
        said = "".join(f"{role}\n{text}\n" for _, role, text in mine)
        loss = "".join(text for _, role, text in mine if role == "assistant")
        expected = (len(mine), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert (got[conv].n_turns, got[conv].turns_sha256, got[conv].loss_chars, got[conv].loss_sha256) == expected
    merged = chat.format_chats(turns).filter("conv_id = 1").first().formatted
    assert merged.count(chat.START) == 3
    assert chat.report(empty(turns)).count() == 0


# Near-duplicates


def shingle_set(text):
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def classes(rows):
    sets = {i: shingle_set(t) for i, t in rows}
    head = {i: i for i in sets}

    def find(i):
        while head[i] != i:
            i = head[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                head[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def test_near_duplicates(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(-1, None), (-2, ""), (-3, "A b"), (-4, "a  B"), (-5, "\t\n")]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(frame(spark, rows)).collect()}
    assert got == classes(rows)


def test_crowded_nodes(spark, monkeypatch):
    """Groups of near copies far larger than a node, a passage that all share, and block pairs."""
    rng = np.random.default_rng(5)
    shared = " ".join(f"s{i}" for i in range(60))
    rows = []
    for i in range(240):
        words = [f"c{i % 3}w{k}" for k in range(150)]
        for k in rng.integers(0, 150, rng.integers(0, 5)):
            words[k] = f"edit{i}_{k}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, shared + " " + " ".join(f"o{i}x{k}" for k in range(90))) for i in range(120)]
    monkeypatch.setattr(neardup, "NODE", 16)
    monkeypatch.setattr(neardup, "GROUP", 4000)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(frame(spark, rows)).collect()}
    assert got == classes(rows)


def test_lone_pairs_in_crowded_nodes(spark, monkeypatch):
    """Pairs alike in 44 of 64 values (0.75 less a standard deviation), each value shared with an eighth of all others."""
    rng = np.random.default_rng(3)
    pairs, rows = 1024, []
    for i in range(pairs):
        a = rng.integers(0, 8, neardup.MINWISE)
        b = a.copy()
        other = rng.permutation(neardup.MINWISE)[:20]
        b[other] = (b[other] + rng.integers(1, 8, 20)) % 8
        rows += [(2 * i, a.tolist()), (2 * i + 1, b.tolist())]
    monkeypatch.setattr(neardup, "NODE", 14)
    edges = neardup.candidates(spark.createDataFrame(rows, "rep long, mins array<int>").repartition(4))
    root = {r.id: r.component for r in components.components(edges).collect()}
    assert len({root.get(i, i) for i in range(2 * pairs)}) > pairs / 2
    assert [i for i in range(pairs) if root.get(2 * i, 2 * i) != root.get(2 * i + 1, 2 * i + 1)] == []


def test_few_beside_a_group(spark, monkeypatch):
    """A crowd of connected documents, and a few beside it that are each like one of them alone."""
    rng = np.random.default_rng(4)
    width, mains, beside = neardup.MINWISE, 300, 10
    base = np.arange(width)
    rows = [(0, base.tolist())]
    for i in range(1, mains):
        a = base.copy()
        edit = rng.permutation(width)
        a[edit[:14]] = 1000 * i + np.arange(14)
        rows.append((i, a.tolist()))
        if i <= beside:
            b = a.copy()
            b[edit[14:34]] = 10**6 + 1000 * i + np.arange(20)
            rows.append((1000 + i, b.tolist()))
    monkeypatch.setattr(neardup, "NODE", 14)
    monkeypatch.setattr(neardup, "SPREAD", 64)
    edges = neardup.candidates(spark.createDataFrame(rows, "rep long, mins array<int>").repartition(4))
    root = {r.id: r.component for r in components.components(edges).collect()}
    assert {root.get(i, i) for i, _ in rows} == {0}
    at = dict(rows)
    assert all(sum(x == y for x, y in zip(at[r.a], at[r.b], strict=True)) >= neardup.SKETCH * width for r in edges.collect())


def test_near_duplicates_awkward(spark, awkward):
    got = sorted((str(r.doc_id), r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(awkward).collect())
    assert [x[:1] + x[2:] for x in got if x[0] in "45"] == [("4", 4, True), ("4", 4, True), ("5", 4, False)]
    assert [x[2:] for x in got if x[0] == "None"] == [(None, True)] * 2
    left = neardup.decide(awkward)
    assert left.columns == awkward.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == ["1", "2", "3", "4", "6", "7", "8", "None", "None"]
    assert neardup.near_duplicates(empty(awkward)).count() == 0


def test_one_id_with_several_texts(spark):
    def words(name, edit=None):
        return " ".join(f"{edit or name}{k}" if k == 50 else f"{name}{k}" for k in range(100))

    rows = [(1, words("a")), (1, words("b")), (2, words("a", "x")), (3, words("b", "y")), (4, words("c")), (5, words("c", "z")), (5, words("d")), (6, words("e")), (6, "e")]
    for rows_now in (rows, rows[::-1]):
        df = frame(spark, rows_now)
        got = {(r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(df).collect()}
        assert got == {(1, 1, True), (2, 1, False), (3, 1, False), (4, 4, True), (5, 4, False), (6, 6, True)}
        left = sorted((r.doc_id, r.text) for r in neardup.decide(df).collect())
        assert left == sorted([rows[0], rows[1], rows[4], rows[6], rows[7], rows[8]])


@pytest.mark.parametrize("alone", [0, 10**6])
def test_components(spark, monkeypatch, alone):
    monkeypatch.setattr(components, "ALONE", alone)
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)] + [(200, 200 + i) for i in range(30)]
    got = {r.id: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100, **{200 + i: 200 for i in range(1, 30)}}


# Repeats


def without_repeats(rows):
    seen, out = set(), {}
    for i, b in rows:
        gone = bytearray(len(b))
        for j in range(len(b) - 99):
            if b[j : j + 100] in seen:
                gone[j : j + 100] = b"\1" * 100
            seen.add(b[j : j + 100])
        runs = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())
    return out


def test_repeats(spark, docs):
    passage = " ".join(f"word{i}" for i in range(80))
    rows = [(r.doc_id, r.text) for r in docs.filter("doc_id < 60").collect()]
    rows += [(1000, None), (1001, ""), (1002, "For " * 300), (1003, "x" * 99), (1004, "x" * 100), (1005, "x" * 400), (1006, "é漢" * 80)]
    rows += [(2000 + i, f"a{i} " * i + passage[i : 400 + i] + f" b{i}" * 9) for i in range(30)] + [(3000, passage), (3001, passage[:250] + passage[250:])]
    expected = without_repeats(sorted((i, (t or "").encode()) for i, t in rows))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.report(frame(spark, rows)).collect()}
    assert got == expected


def test_repeats_in_small_parts(spark, docs, monkeypatch):
    """Many shards, and tasks that hold little back."""
    monkeypatch.setattr(repeats, "HELD", 3000)
    monkeypatch.setattr(repeats, "SHARD", 4000)
    rows = sorted((r.doc_id, r.text.encode()) for r in docs.filter("doc_id < 80").collect())
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.report(docs.filter("doc_id < 80")).collect()}
    assert got == without_repeats(rows)


def test_repeated_rows(spark, awkward):
    got = sorted((str(r.doc_id), r.n_removed == 0) for r in repeats.report(awkward).collect() if r.n_bytes > 100)
    assert got == [("4", True), ("4", True), ("5", False), ("6", False), ("7", False), ("None", False)]
    assert repeats.report(empty(awkward)).count() == 0


def test_run_index():
    """The samples at run ends give the matching statistic of every suffix, and the runs give back the text."""
    parts = [b"abracadabra" * 12, b"abracadabra" * 11 + b"!", b"mississippi" * 13, b"abracadabra" * 12]
    data = np.frombuffer(b"".join(p + b"\xff" for p in parts), np.uint8)
    size = np.array([len(p) for p in parts])
    index = repeats.RunIndex(data, size)
    assert len(index.at) < len(data) / 8 and index.lengths.sum() == len(data)
    # A suffix ends with its segment; the number of the segment tells separators apart.
    suffixes = sorted((bytes(p[k:]), s, sum(size[:s] + 1) + k) for s, p in enumerate(parts) for k in range(len(p) + 1))
    above, alike = index.statistics(np.arange(len(data)))
    for (x, _, i), (y, _, j) in zip(suffixes, suffixes[1:]):
        assert above[j] == i
        assert alike[j] == next((k for k, (a, b) in enumerate(zip(x, y)) if a != b), min(len(x), len(y)))
    symbols = np.repeat(index.symbols, index.lengths)
    step = np.empty(len(symbols), np.int64)
    step[np.argsort(symbols, kind="stable")] = np.arange(len(symbols))
    for k, part in enumerate(parts):
        row, said = k, []
        while symbols[row]:
            said.append(int(symbols[row]) - 1)
            row = step[row]
        assert bytes(said[::-1]) == part


def test_common_passage_is_sent_once_by_each_task(spark):
    """A passage of very many places: its shard gets as many rows as there are tasks, not places, and gives the same result."""
    passage = " ".join(f"common{i}" for i in range(40))
    rows = [(i, f"{i * 7919} " * (i % 3) + passage + f" {i} end") for i in range(3000)]
    df = frame(spark, rows).repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.report(df).collect()}
    assert got == without_repeats([(i, t.encode()) for i, t in rows])
    keyed = df.withColumns({"key": F.xxhash64("doc_id"), "check": F.hash("doc_id")})
    wanted = repeats.repeated(repeats.runs(keyed, 4), 4)
    places = sum(len(r.counts) for r in wanted.collect())
    sent = sum(len(r.sizes) for r in repeats.segments(keyed, repeats.per_document(wanted, 4), 4).collect())
    assert places > 3000 * 5 and sent < places / 3


@pytest.mark.parametrize("batch", [300, 1500, 10**6])
def test_crowded_anchor(monkeypatch, batch):
    """An anchor with more distinct surroundings than an index may hold is parted by other anchors; the windows' result is the same."""
    monkeypatch.setattr(repeats, "BATCH", batch)
    rng = np.random.default_rng(9)
    gram = rng.integers(97, 123, 60)
    parts = [np.concatenate([rng.integers(97, 123, 50), gram, rng.integers(97, 123, 30 + k % 36)]) for k in range(60)]
    parts += [np.concatenate([p[15 + k % 9 :], p[:3]]) for k, p in enumerate(parts[::3])] + [np.repeat(97, 176)]
    size = np.array([len(p) for p in parts])
    data, begin = np.concatenate(parts).astype(np.uint8), np.cumsum(size) - size
    place = rng.permutation(len(parts)).astype(np.int64) << 32
    least = {}
    windows = [[data[b + k : b + k + 100].tobytes() for k in range(n - 99)] for b, n in zip(begin, size)]
    for own, at in zip(windows, place.tolist()):
        for k, w in enumerate(own):
            least[w] = min(least.get(w, at + k), at + k)
    expected = [least[w] < at + k for own, at in zip(windows, place.tolist()) for k, w in enumerate(own)]
    assert 200 < sum(expected) < len(expected) - 200
    for mark in (np.zeros(len(parts), np.uint64), np.repeat(np.arange(9, dtype=np.uint64), 9)):
        got = repeats.earlier(data, begin, size, place, mark)
        assert got.tolist() == expected if not mark.any() else not (got & ~np.array(expected)).any()


def test_memory_of_segments(spark, monkeypatch):
    """Segments are hashed a block at a time and an index holds few numbers for a symbol; blocks don't change the result."""

    def peak(run):
        monkeypatch.setattr(repeats.text.Powers, "up", np.ones(1, np.uint64))
        monkeypatch.setattr(repeats.text.Powers, "down", np.ones(1, np.uint64))
        tracemalloc.start()
        try:
            return run(), tracemalloc.get_traced_memory()[1]
        finally:
            tracemalloc.stop()

    rng = np.random.default_rng(3)
    size = rng.integers(100, 177, 60_000)
    begin = np.cumsum(size) - size
    data = rng.integers(97, 123, int(size.sum())).astype(np.uint8)
    # Two segments that are equal, far apart; the second one has the earlier place.
    size[59_000] = size[5] = min(size[59_000], size[5])
    data[begin[59_000] : begin[59_000] + size[5]] = data[begin[5] : begin[5] + size[5]]
    place = np.arange(60_000)[::-1]
    one, distinct = peak(lambda: repeats._distinct(data, begin, size, place))
    assert sorted(one.tolist()) == [k for k in range(60_000) if k != 5] and distinct < 8 * len(data)
    marks, marking = peak(lambda: repeats._marks(data, begin))
    assert marking < 8 * len(data)
    for k in (0, 1, 30_000, 59_999):
        assert marks[k] == repeats._grams(data[begin[k] : begin[k] + 100]).min()
    gone, index = peak(lambda: repeats.earlier(data, begin, size, place << 32, marks))
    assert gone.sum() == size[5] - 99 and index < 120 * repeats.BATCH
    # Four shards share a task, and so a file.
    dealt = repeats._dealt(spark.range(400).withColumnRenamed("id", "number"), 400)
    assert collections.Counter(r[0] for r in dealt.select(F.spark_partition_id()).collect()) == {k: 4 for k in range(100)}


def test_runs_of_marked_windows():
    gone = np.array([1, 1, 0, 1, 1, 1, 0, 0, 1, 1], bool)
    # Runs end with their segment.
    assert [x.tolist() for x in repeats._stretched(gone, np.array([4, 1, 3, 2]))] == [[0, 0, 1, 2, 3], [0, 3, 0, 0, 0], [2, 1, 1, 1, 2]]


def test_removed_bytes():
    rng = np.random.default_rng(4)
    for n in (0, 1, 2, 40):
        body = rng.integers(97, 123, 3000).astype(np.uint8)
        count = rng.integers(1, 78, n).astype(np.uint8)
        start = np.sort(rng.integers(0, 2800, n)).astype(np.int32)
        # Runs that touch are one, also at both ends of the text.
        if n > 1:
            start[0], start[1] = 0, count[0] + 99
            start, count = np.append(start, 3000 - 100).astype(np.int32), np.append(count, 1).astype(np.uint8)
            order = np.argsort(start, kind="stable")
            start, count = start[order], count[order]
        gone = bytearray(3000)
        for a, c in zip(start.tolist(), count.tolist()):
            gone[a : a + c + 99] = b"\1" * (c + 99)
        spans, kept = repeats._removed(body, start, count)
        assert [tuple(x) for x in spans.tolist()] == [m.span() for m in re.finditer(b"\1+", gone)]
        assert kept == bytes(x for x, g in zip(body.tolist(), gone) if not g)


def test_long_text_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(repeats, "PIECE", 1000)
    rows = [(1, " ".join(f"w{i % 900}" for i in range(4000))), (2, " ".join(f"w{i % 900}" for i in range(300, 700)))]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.report(frame(spark, rows)).collect()}
    assert got == without_repeats([(i, t.encode()) for i, t in rows])


# Sharding


def test_sharding(spark, docs, monkeypatch):
    limit = 20_000
    got = sharding.report(docs, limit).collect()
    sizes = collections.Counter()
    for r in got:
        sizes[r.shard] += r.n_bytes
    assert len(got) == docs.count() and len(sizes) > 20
    alone = collections.Counter(r.shard for r in got)
    assert all(n <= limit or alone[s] == 1 for s, n in sizes.items())
    names = sorted(s[1:].split(".")[0] for s in sizes)
    assert all(not b.startswith(a) for a, b in zip(names, names[1:]) if a != b)


def test_sharding_equal_rows(spark, awkward):
    many = frame(spark, [(1, "x" * 100)] * 50 + [(2, "y" * 5000), (None, None)])
    got = sharding.assign(many, 1000)
    assert set(many.columns) <= set(got.columns)
    parts = collections.Counter(r.shard for r in got.filter("doc_id = 1").collect())
    assert sorted(parts.values()) == [10] * 5
    assert sharding.report(empty(many), 1000).count() == 0
    assert sharding.report(awkward).count() == awkward.count()
    clash = awkward.withColumns({c: F.lit(c) for c in ("shard_depth", "n_bytes", "__key", "__cell12")})
    got = sharding.assign(clash)
    assert set(got.columns) == set(clash.columns) and got.filter("__key = '__key' and __cell12 = '__cell12' and shard like 'b%'").count() == clash.count()


# Toxicity and mixing


def test_toxicity_learns_pairs():
    """Two words that are harmless alone or together and toxic one without the other, on rows that were not learnt from: no linear weights can tell."""
    rng = np.random.default_rng(1)

    def rows(n):
        out = []
        for _ in range(n):
            a, b = rng.integers(0, 2, 2)
            terms = {*([11] if a else []), *([22] if b else []), *rng.integers(100, 130, 5).tolist()}
            out.append((int(a != b), np.array(sorted(terms), np.int32).tobytes()))
        return out

    model = toxicity.fit(rows(1200))
    right = []
    for y, t in rows(600):
        slot = np.unique(model.slots[np.frombuffer(t, np.int32)])
        slot = slot[slot >= 0]
        right.append((model.raw(np.zeros(len(slot), np.int64), slot, 1)[0] > 0) == y)
    assert np.mean(right) > 0.95


def test_toxicity_scores(spark, docs, small):
    """Scores against the machine's formula, pair by pair."""
    from shardlore.llm import text

    model = toxicity.train(docs, spark.read.parquet(f"{small}/labels.parquet"))
    assert len(model.w) > 20
    got = toxicity.score(docs.filter("doc_id < 40").unionByName(docs.limit(1).withColumns({"doc_id": F.lit(-1).cast("long"), "text": F.lit("")})), model)
    for r in got.collect():
        slots = set()
        for word in WORDS.findall(r.text.translate(LOWER)):
            stems = [text.hash_of(word)] + [int((text.hashes(np.frombuffer(word.encode(), np.uint8), np.array([0]), np.array([n]))[0]) + np.uint64(n)) for n in toxicity.STEMS if len(word.encode()) > n]
            slots |= {int(model.slots[h >> (64 - toxicity.BITS)]) for h in stems}
        slots = sorted(slots - {-1})
        z = model.bias + sum(float(model.w[s]) for s in slots)
        z += sum(float(model.v[s] @ model.v[t]) for k, s in enumerate(slots) for t in slots[k + 1 :])
        assert abs(r.toxic_score - 1 / (1 + np.exp(-np.clip(z, -30, 30)))) < 1e-3


def test_toxicity(spark):
    folder = "/root/testdata/sf0.01"
    got = toxicity.query(spark, folder).toPandas().set_index("doc_id")
    labels = spark.read.parquet(f"{folder}/labels.parquet").toPandas().set_index("doc_id")
    both = got.join(labels, how="inner")
    assert all(got.held_out[i] == (zlib.crc32(str(i).encode()) % 3 == 1) for i in got.index)
    held = both[both.held_out]
    toxic, clean = held[held.toxic == 1].score, held[held.toxic == 0].score
    assert np.mean([np.mean(t > clean) + np.mean(t == clean) / 2 for t in toxic]) > 0.8
    assert held[held.toxic == 0].predicted.mean() < 0.03
    assert ((got.score >= 0.7) == (got.predicted == 1)).all()


def test_toxicity_awkward(spark, awkward):
    labels = spark.createDataFrame([(4, 1), (4, 0), (5, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(awkward, labels)
    got = toxicity.score(awkward, model)
    assert got.count() == awkward.count() and got.filter("toxic_score between 0 and 1").count() == awkward.count()
    none = toxicity.train(awkward, empty(labels))
    assert toxicity.score(awkward, none).agg(F.max("toxic_score")).first()[0] < 0.01
    assert toxicity.score(empty(awkward), model).count() == 0
    clash = awkward.withColumn("toxic_score", F.lit("x"))
    left = toxicity.decide(clash, clash, empty(labels))
    assert left.columns == clash.columns and {r.toxic_score for r in left.collect()} == {"x"}


def test_rates_meet_targets(spark):
    rng = np.random.default_rng(2)
    p = rng.dirichlet((2.0, 0.4, 0.3), 300)
    tokens = rng.integers(1, 2000, 300)
    known = spark.createDataFrame([(x.tolist(), int(t)) for x, t in zip(p, tokens, strict=True)], "posterior array<double>, n_tokens long")
    got = mixing.rates(known, {"good": 0.5, "poor": 0.3, "toxic": 0.2}).collect()
    assert sum(r.n_tokens for r in got) == tokens.sum() and all(r.rate >= 0 for r in got)
    totals = np.sum([np.array(r.posterior) * r.n_tokens * r.rate for r in got], axis=0)
    assert np.abs(totals / totals.sum() - [0.5, 0.3, 0.2]).max() < 0.003
    # The least squares over the bound that change the rates least have gradients of zero, or of the right sign where a rate is held at 0.
    rate = np.array([r.rate for r in got])
    assert (rate == 0).any() and np.linalg.matrix_rank(np.array([r.posterior for r in got])[rate > 0]) == 3
    bounded = mixing.rates(known, {"good": 0.5, "poor": 0.3, "toxic": 0.2}, least=1.0).collect()
    assert min(r.rate for r in bounded) >= 1.0
    # These targets can't be met: the squared distance is that of many plain projected gradient steps.
    goal = max((tokens @ p) / [0.5, 0.3, 0.2]) * np.array([0.5, 0.3, 0.2])
    plain, gram = np.ones(300), (p * (tokens @ p / goal**2)).sum(axis=1).max()
    for _ in range(30_000):
        plain = np.maximum(1.0, plain - (p @ (((plain * tokens) @ p / goal - 1) / goal)) / gram)
    totals = np.sum([np.array(r.posterior) * r.n_tokens * r.rate for r in bounded], axis=0)
    best = np.square((plain * tokens) @ p / goal - 1).sum()
    assert best > 0.005 and np.square(totals / goal - 1).sum() < 1.02 * best


def mixed(spark, rest, **options):
    """Totals by domain before and after, of fifty mixed posteriors without the third domain, one that is all of the first and one all of the third."""
    rng = np.random.default_rng(4)
    poor = rng.beta(0.5, 1.5, 50)
    rows = {(1 - q, q, 0.0): 0 for q in [0.0, *poor.tolist()]}
    for k in rows:
        rows[k] = int(rng.integers(1000, 20_000))
    rows[0.0, 0.0, 1.0] = max(1, int(sum(rows.values()) * rest))
    known = spark.createDataFrame([(list(k), v) for k, v in rows.items()], "posterior array<double>, n_tokens long")
    got = mixing.rates(known, **options).collect()
    return np.sum([np.array(k) * v for k, v in rows.items()], axis=0), np.sum([np.array(r.posterior) * r.n_tokens * r.rate for r in got], axis=0)


@pytest.mark.parametrize("rest", [0.01, 0.0005])
def test_scarce_domain_meets_its_target(spark, rest):
    before, after = mixed(spark, rest)
    budget = max(b / w for b, w in zip(before, mixing.TARGETS.values(), strict=True))
    assert np.abs(after / (budget * np.array(list(mixing.TARGETS.values()))) - 1).max() < mixing.CLOSE


def test_residue_without_target(spark):
    _, after = mixed(spark, 0.001, targets={"good": 0.85, "poor": 0.15}, least=1.0)
    assert np.abs(after[:2] / after[:2].sum() - [0.85, 0.15]).max() < 0.002


def test_missed_target_is_told(spark):
    known = spark.createDataFrame([([0.5, 0.5, 0.0], 1000), ([0.4, 0.6, 0.0], 1000)], "posterior array<double>, n_tokens long")
    with pytest.warns(UserWarning, match="targets missed"):
        mixing.rates(known, {"good": 0.9, "poor": 0.1})


def test_mixing_awkward(spark, awkward):
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, None), (6, None, 1), (None, 1, 1), (8, None, None)], "doc_id long, quality int, toxic int")
    got = mixing.mix(awkward, labels)
    assert got.count() == awkward.count() and got.filter("rate < 0 or copies < 0").count() == 0
    assert got.filter("n_tokens = 0 and rate <> 1").count() == 0
    left = mixing.decide(awkward, labels, awkward)
    assert left.columns == awkward.columns and left.distinct().count() == awkward.distinct().count()
    assert mixing.mix(awkward, empty(labels)).count() == awkward.count()
    clash = awkward.withColumns({c: F.lit(c) for c in ("n_tokens", "posterior", "rate", "copies", "copy", "__chance")})
    left = mixing.decide(clash, labels, clash)
    assert left.columns == clash.columns and {tuple(r) for r in left.select("n_tokens", "rate", "copy", "__chance").collect()} == {("n_tokens", "rate", "copy", "__chance")}
    assert set(clash.columns) == set(mixing.mix(clash, labels).columns)
    assert mixing.mix(empty(awkward), labels).count() == 0
