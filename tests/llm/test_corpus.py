"""Toxicity, secrets, fuzzy lines, rules and near copies against plain versions and edge cases."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillwise.llm import caps, declist, fuzzylines, rulefit, secrets, simhash, toxicity
from tillwise.llm.statistics import features, measures

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = [
    None, "", " \n\t", "one", "a b c a b c a b", "x x x x x", "l1\nl1\n\nl2\nl1 ", "É!! 12 # $|", "🙂 a b 🙂 a b\n🙂 a b",
    "q " * 3000, "long" * 5000, 'token = "abcdef0123" password:abc secret==abcdefg', "token:token:abcdef", "é AKIA" + "A1" * 9 + " " + "0a" * 15,
]


@pytest.fixture(scope="module")
def frame(spark):
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS)] + [(None, "no id", "c"), (4, TEXTS[4], "c"), (4, TEXTS[4], "c")]
    return spark.createDataFrame(rows, "doc_id long, text string, blob string")


def plain_measures(text):
    text = text or ""
    w = WORD.findall(text)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    count = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if count[g] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def test_measures(spark, frame):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(frame.select("doc_id", "text"))
    rows = measures(docs, "text").collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == plain_measures(r["text"])


def plain_spans(text):
    rules = [(re.compile(p.removeprefix("(?i)"), re.A | (re.I if p.startswith("(?i)") else 0)), k, g, n) for k, p, g, n in secrets.RULES]
    found = [(m.start(), i, k, m.end()) for i, (p, k, g, n) in enumerate(rules) for m in p.finditer(text or "") if len(m[g]) >= n]
    return sorted(found)


def test_secrets(spark, frame):
    for docs in (spark.read.parquet(f"{SF}/documents.parquet"), frame):
        texts = {}
        for r in docs.collect():
            texts[r["doc_id"]] = r["text"]
        rows = secrets.report(secrets.findings(docs)).collect()
        assert len(rows) == docs.count()
        for r in rows:
            spans = plain_spans(texts[r["doc_id"]])
            joined = lambda kinds: ",".join(f"{k}:{a}:{b}" for a, _, k, b in spans if k in kinds)
            assert r["spans"] == joined([x[0] for x in secrets.RULES])
            assert r["base_sha256"] == hashlib.sha256(joined(secrets.BASE).encode()).hexdigest()
    assert secrets.findings(frame.limit(0)).count() == 0


def test_ledger_scans_unseen_pairs_only(spark, frame, tmp_path):
    ledger = str(tmp_path / "ledger")
    first = secrets.update(frame, ledger).count()
    assert secrets.update(frame, ledger).count() == first == len({t or "" for t in TEXTS}) + 1
    more = spark.createDataFrame([(99, "new token = abcdefgh"), (98, "one")], "doc_id long, text string")
    assert secrets.update(more, ledger).count() == first + 1
    other = secrets.RULES[:1]
    assert secrets.update(more, ledger, other).count() == 2  # another version of the rules has seen nothing
    both = str(tmp_path / "both")
    blobs = secrets.addressed(more).select("blob", "text")
    for _ in range(2):  # as two runs do that both saw an empty ledger
        secrets.scan(blobs).write.mode("append").parquet(both)
    assert secrets.update(more, both).count() == 2 and secrets.findings(more, both).count() == 2


def test_long_credentials_and_key_bodies(spark):
    link = f"postgres://{'u' * 90}:{'p' * 400}@"
    key = "-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0A\n\nMIIabc+/=\nQQ==\n-----END RSA PRIVATE KEY-----"
    open_key = "-----BEGIN PRIVATE KEY-----"
    docs = spark.createDataFrame([(1, f"é {link}host"), (2, f"x {key} y"), (3, f"{open_key}\nMII - and prose")], "doc_id long, text string")
    spans = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in secrets.findings(docs).collect()}
    assert ("url", 2, 2 + len(link)) in spans[1]
    assert ("pem", 2, 2 + len(key)) in spans[2]
    assert spans[3] == [("pem", 0, len(open_key))]


def plain_shingles(line, n=fuzzylines.CHARS):
    return {line[i : i + n] for i in range(len(line) - n + 1)} if len(line) > n else {line}


def test_fuzzy_lines(spark):
    base = "the quick brown fox jumps over the lazy dog and then walks slowly back to its den by the river bank {}"
    lines = [base.format(i) for i in range(60)] + [f"line number {i * i} about {hashlib.md5(str(i).encode()).hexdigest()}" for i in range(40)]
    rows = [(i, "\n".join([lines[i], "", "short", lines[(i * 7) % 100]]), "x") for i in range(100)]
    rows += [(None, lines[0], "x"), (200, None, "x"), (201, "", "x"), (202, "w" * 5000, "x"), (202, "w" * 5000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, first string")
    out = fuzzylines.dedup(docs).collect()
    places = sorted((d is None, d or 0, k, p, line) for k, (d, t, _) in enumerate(rows) if t for p, line in enumerate(t.split("\n")) if WORD.search(line))
    kept = []
    root = {}
    for *_, line in places:
        root.setdefault(line, line)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    names = list(root)
    for i, a in enumerate(names):
        for b in names[:i]:
            x, y = plain_shingles(a), plain_shingles(b)
            if len(x & y) >= fuzzylines.JACCARD * len(x | y):
                root[find(a)] = find(b)
    seen = set()
    for _, d, _, _, line in places:
        if find(line) not in seen:
            seen.add(find(line))
            kept.append(line)
    got = [x for r in out if r["text"] for x in r["text"].split("\n") if WORD.search(x)]
    assert sorted(got) == sorted(kept) and len(out) == len(rows)
    assert [r["text"] for r in out if r["doc_id"] == 200] == [None]
    assert sum(r["n_lines"] - r["n_dropped"] for r in out) == len(got) + sum(not WORD.search(x) for _, t, _ in rows if t is not None for x in t.split("\n"))
    assert fuzzylines.dedup(docs.limit(0)).count() == 0


def test_fuzzy_lines_pass_any_column_name(spark):
    names = "_row _late _n _none _text _kept _h pos line first n id row component lang".split()
    rows = [(i, t, *[f"{c}{i}" for c in names], 7) for i, t in enumerate(["a line of text here\nanother line", "a line of text here", None, ""])]
    docs = spark.createDataFrame(rows, f"doc_id long, text string, {', '.join(f'{c} string' for c in names)}, n_lines int")
    found = {r["doc_id"]: r for r in fuzzylines.dedup(docs).collect()}
    assert {i: r["text"] for i, r in found.items()} == {0: rows[0][1], 1: "", 2: None, 3: ""}
    assert all(r[c] == f"{c}{i}" for i, r in found.items() for c in names)
    assert found[0]["n_lines"] == 2 and found[1]["n_dropped"] == 1


def test_fuzzy_short_lines(spark):
    draw = random.Random(3)
    text = lambda n: "".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=n))
    pairs = []
    for n in range(4, 21):
        for _ in range(40):
            x, more = text(n + 7), text(n // 4)  # n of n + n // 4 shingles are shared
            pairs.append((x, x + more if draw.random() < 0.5 else more + x))
    assert all(len(plain_shingles(x)) / len(plain_shingles(y)) >= fuzzylines.JACCARD for x, y in pairs)
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(x for pair in pairs for x in pair)], "doc_id long, text string")
    out = fuzzylines.dedup(docs).where("n_dropped > 0").collect()
    assert sorted(r["doc_id"] for r in out) == list(range(1, 2 * len(pairs), 2))


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    truth = {r["doc_id"]: r for r in labels.collect()}

    def accuracy(rows, label):
        hits = [r["predicted"] == truth[r["doc_id"]][label] for r in rows if r["held_out"] and r["doc_id"] in truth]
        return np.mean(hits)

    toxic = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    assert accuracy(toxic, "toxic") > 0.9 and all(0 <= r["score"] <= 1 for r in toxic) and len(toxic) == docs.count()
    learn = "crc32(cast(cast(doc_id as string) as binary)) % 5 != 0"
    from pyspark.sql import functions as F

    good = rulefit.score(docs, rulefit.fit(docs, labels, where=F.expr(learn))).collect()
    assert accuracy(good, "quality") > 0.9 and all(0 <= r["score"] <= 1 for r in good)
    judged = declist.judge(docs, declist.fit(docs, labels)).collect()
    assert np.mean([r["kept"] for r in judged if r["n_words"] >= 50 and truth.get(r["doc_id"], {"quality": 0})["quality"]]) > 0.95


def test_toxic_recall(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.score(docs, toxicity.fit(docs, labels)).where("held_out").join(labels, "doc_id").where("toxic is not null").collect()
    truth, given = (np.array([r[c] for r in rows]) == 1 for c in ("toxic", "predicted"))
    recall, precision = (truth & given).sum() / truth.sum(), (truth & given).sum() / given.sum()
    print(f"recall {recall:.3f} precision {precision:.3f} of {truth.sum()} toxic")
    assert recall >= 0.75 and precision >= 0.9


def test_rare_toxic_words_count(spark):
    texts = [(["rare"] if i < 4 else []) + ["all", f"own{i}"] for i in range(40)] + [["all", f"own{i}"] for i in range(40, 800)]
    sample = spark.createDataFrame([(t, i < 40) for i, t in enumerate(texts)], "words array<string>, positive boolean")
    lifted = toxicity.chosen_words(sample, 40, 760)
    assert 0.8 < lifted["rare"] < 1 and "all" not in lifted
    mixed = [["rare"]] + [["often"]] * 30 + [[]] * 729
    sample = spark.createDataFrame([(t, i < 40) for i, t in enumerate([["often"]] * 3 + [[]] * 37 + mixed)], "words array<string>, positive boolean")
    assert toxicity.chosen_words(sample, 40, 760)["often"] < 0.4  # 3 of 40 against 30 of 760 may be chance


def test_models_without_labels(spark, frame):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in toxicity.score(frame, toxicity.fit(frame, labels)).collect()} == {0.0}
    assert {r["score"] for r in rulefit.score(frame, rulefit.train(np.zeros((0, 9)), np.zeros(0))).collect()} == {0.5}
    assert declist.judge(frame, declist.train(np.zeros((0, 9)), np.zeros(0, bool))).count() == frame.count()
    assert len(features()) == 9


def components_of(n, near):
    root = list(range(n))
    changed = True
    while changed:
        changed = False
        for i in range(n):
            for j in range(n):
                if near[i, j] and root[j] > root[i]:
                    root[j], changed = root[i], True
    return root


def test_simhash(spark, frame):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = sorted(simhash.groups(docs).collect(), key=lambda r: r["doc_id"])
    prints = np.array([int(r["fingerprint"], 16) for r in rows], np.uint64)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(int(r["fingerprint"], 16) == simhash.fingerprint(texts[r["doc_id"]]) % (1 << 64) for r in rows)
    near = np.bitwise_count(prints[:, None] ^ prints[None]) <= 4
    assert [r["component_id"] for r in rows] == [rows[k]["doc_id"] for k in components_of(len(rows), near)]
    assert simhash.groups(frame).count() == frame.count() and simhash.groups(frame.limit(0)).count() == 0


def test_caps(spark):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = sorted(caps.near_duplicates(vectors).collect(), key=lambda r: r["vec_id"])
    given = {r["vec_id"]: r["embedding"] for r in vectors.collect()}
    x = np.array([given[r["vec_id"]] for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    found, true = sum(r["n_links"] for r in rows), near.sum()
    assert all(r["n_links"] <= n for r, n in zip(rows, near.sum(axis=1))) and found >= 0.9 * true


def planted(vectors, cosine, seed):
    """A unit vector at this cosine from each of the given unit vectors."""
    side = np.random.default_rng(seed).standard_normal(vectors.shape)
    side -= (side * vectors).sum(axis=1, keepdims=True) * vectors
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    return cosine * vectors + np.sqrt(1 - cosine * cosine) * side


@pytest.mark.parametrize("rows", [800, 100_000])
def test_caps_decode_every_vector(rows):
    unit = caps._unit(np.random.default_rng(5).standard_normal((300, 64)))
    codes = [caps.ProductCode(64, caps.code_size(rows), turn=k) for k in range(caps.CODES)]
    lists = [[set(x.tolist()) for x in code.decode(unit)] for code in codes]
    assert all(all(row) for row in lists)
    for k, cosine in enumerate((0.951, 0.97, 0.99, 0.999)):
        near = [list(code.decode(planted(unit, cosine, k))) for code in codes]
        met = [any(lists[c][i] & set(near[c][i].tolist()) for c in range(caps.CODES)) for i in range(300)]
        assert np.mean(met) >= 0.99, cosine


def test_caps_links_planted_pairs(spark):
    unit = caps._unit(np.random.default_rng(4).standard_normal((100, 64)))
    x = np.concatenate([unit] + [planted(unit, c, k) for k, c in enumerate((0.951, 0.97, 0.99, 0.999))])
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    rows = {r["vec_id"]: r for r in caps.near_duplicates(vectors).collect()}
    assert all(rows[i]["n_links"] <= n for i, n in enumerate(near.sum(axis=1)))
    assert sum(r["n_links"] for r in rows.values()) >= 0.99 * near.sum()
    assert np.mean([rows[i]["component_id"] == i % 100 for i in range(500)]) >= 0.99


def test_rare_pairs_hold_every_link(spark):
    words = [hashlib.md5(str(i).encode()).hexdigest()[:5] for i in range(60)]
    texts = [" ".join(words[(i * k) % 59] if k % (4 + i % 9) == 0 else words[k] for k in range(14)) for i in range(80)]
    lines = spark.createDataFrame(list(enumerate(texts)), "id long, line string")
    found = {tuple(r) for r in fuzzylines.rare_pairs(lines.selectExpr("id", "id component"), lines).collect()}
    sets = [plain_shingles(t) for t in texts]
    near = {(a, b) for a in range(80) for b in range(a + 1, 80) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert near and near <= found and len(found) < 80 * 79 / 2


def test_hashes_pass_every_similar_pair():
    """What the hashes rule out is not similar by its strings; short, empty, equal and very long lines included."""
    draw = random.Random(5)
    xs, ys = ["", "", "abc"], ["", "abc", "abd"]
    for _ in range(3000):
        x = [draw.choice("abcde é🙂") for _ in range(draw.choice([0, 3, 8, 9, 30, 100, 300]))]
        y = list(x)
        for _ in range(draw.choice([0, 1, 2, 5])):
            if y:
                y[draw.randrange(len(y))] = "z"
        xs.append("".join(x))
        ys.append("".join(y + list("tail" * draw.randrange(3))))
    xs.append("q w e " * 300000)
    ys.append(xs[-1] + "x")
    slices = list(fuzzylines._pair_groups(xs, ys))
    assert [i for low, high in slices for i in range(low, high)] == list(range(len(xs)))
    passed = [bool(k) for low, high in slices for k in fuzzylines.near_by_hashes(xs[low:high], ys[low:high], 0.8, 8)]
    for x, y, k in zip(xs, ys, passed):
        p, q = fuzzylines.shingles(x), fuzzylines.shingles(y)
        assert k or len(p & q) < 0.8 * len(p | q)
    assert not all(passed)


def test_fuzzy_lines_use_column_functions_only(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a line of text here\nanother line"), (2, "a line of text here"), (3, None)], "doc_id long, text string")
    for name in ("mapInArrow", "mapInPandas"):
        monkeypatch.setattr(type(docs), name, lambda *_: pytest.fail("Python on the executors"))
    assert sorted(r["n_dropped"] for r in fuzzylines.dedup(docs).collect()) == [0, 0, 1]


def test_shingle_hashes_are_those_of_the_plain_shingles(spark):
    """Short, long, ASCII and other lines alike, also where pieces of a line meet."""
    draw = random.Random(1)
    lines = ["", "abc", "abcdefgh", "\u00e9abcdefghij", "x" * 3000]
    lines += ["".join(draw.choices(kind, k=n)) for kind in ("abcdefgh ", "abcd\u00e9\U0001f642 ") for n in (9, 50, 1024, 1031, 1032, 1033, 2060)]
    rows = spark.createDataFrame(list(enumerate(lines)), "i int, line string")
    found = {r["i"]: r["h"] for r in rows.select("i", fuzzylines.shingle_hashes(F.col("line")).alias("h")).collect()}
    plain = spark.createDataFrame([(i, x) for i, line in enumerate(lines) for x in plain_shingles(line)], "i int, x string")
    wanted = {r["i"]: r["h"] for r in plain.groupBy("i").agg(F.collect_set(F.xxhash64("x")).alias("h")).collect()}
    assert {i: sorted(h) for i, h in found.items()} == {i: sorted(h) for i, h in wanted.items()}


def test_unlike_variants_of_one_line_are_not_paired_up(spark, monkeypatch):
    """Variants that share a bucket but are not similar make few pairs, not the square of their number."""
    draw = random.Random(7)
    base = "".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=240))
    lines = [base + "".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=80)) for _ in range(120)]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    checked, verified = [], fuzzylines.verified
    monkeypatch.setattr(fuzzylines, "verified", lambda pairs, *rest: checked.append(pairs.count()) or verified(pairs, *rest))
    assert fuzzylines.dedup(docs).agg(F.sum("n_dropped")).first()[0] == 0
    assert sum(checked) <= 12 * len(lines)


def test_hashes_in_rows_tell_the_plain_shingles_apart(spark):
    """Short, long, ASCII and other lines alike: as many different hashes as shingles, and the same for the same shingle."""
    draw = random.Random(2)
    lines = ["", "abc", "abcdefgh", "éabcdefghij", "x" * 3000]
    lines += ["".join(draw.choices(kind, k=n)) for kind in ("abcdefgh ", "abcdé\U0001f642 ") for n in (9, 38, 39, 40, 70, 71, 72, 500)]
    lines += [line[3:] + "tail" for line in lines]
    rows = spark.createDataFrame(list(enumerate(lines)), "i int, line string")
    hashed = fuzzylines.line_hashes_in_rows(rows)
    found = {r["i"]: set(r["hashes"]) for r in hashed.collect()}
    for i, line in enumerate(lines):
        assert len(found[i]) == len(plain_shingles(line))
        for j in range(i):
            assert len(found[i] & found[j]) == len(plain_shingles(line) & plain_shingles(lines[j]))
    assert len(found) == len(lines)
    plan = hashed._jdf.queryExecution().executedPlan().toString()
    assert "lambda" not in plan  # no shingle is hashed by interpreted code


def test_variants_of_a_family_meet_where_they_may_be_similar(spark, monkeypatch):
    """Lines of few words share most of their shingles by chance; no link is missing, few others are found, in small and large families."""
    draw = random.Random(11)
    words = ["".join(draw.choices("abcdefgh", k=draw.randrange(2, 6))) for _ in range(60)]
    texts, family = [], []
    for f in range(10):
        base = draw.choices(words, k=70)
        for _ in range(12):
            rate = draw.choice([0.02, 0.12])
            texts.append(" ".join(draw.choice(words) if draw.random() < rate else w for w in base))
            family.append(f)
    sets = [plain_shingles(t) for t in texts]
    pairs = [(a, b) for a in range(120) for b in range(a + 1, 120) if family[a] == family[b]]
    near = {(a, b) for a, b in pairs if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    lines = spark.createDataFrame(list(enumerate(texts)), "id long, line string")
    members = spark.createDataFrame([(i, i, f) for i, f in enumerate(family)], "id long, component long, family long")
    found = {tuple(r) for r in fuzzylines.rare_pairs(members, lines).collect()}
    assert near and near <= found and len(found) < len(near) + len(pairs) / 4
    monkeypatch.setattr(fuzzylines, "FAMILY", 2)
    found = {tuple(r) for r in fuzzylines.rare_pairs(members, lines).collect()}
    assert near <= found <= set(pairs)
