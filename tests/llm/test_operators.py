"""Each operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing names, by brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepair.llm import counts, decontaminate, language, mixing, neardup, quality, secrets, substrings, tokens, urls
from tidepair.llm.common import ship_package

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, s string, hits string, spans string, rid string, size string"


def some_texts():
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    base, long_ = text(120), text(9000)
    near = base.split()
    near[40] = "changed"
    line = text(60)
    return [None, "", " \t\n", "one", "One two", "one two", base, base, base.upper(), " ".join(near), long_, long_ + " end", "ab" * 400,
            "x" * 900, line + "\n" + line + "\n\n" + text(20), line + " tail " + text(30), text(50), "Grüße né 中文 ½ İ Σ", "a b c d e f g h i j k"]


@pytest.fixture(scope="module")
def docs(spark):
    """Texts above; id 3 twice as a whole row, a null id, null and hot sources, column names that operators use too."""
    ship_package(spark)
    rows = [(i, t, ["en", "de", None][i % 3], ["hot", "hot", "b", None][i % 4], 0, "r", "s", "h", "p", "i", "z") for i, t in enumerate(some_texts())]
    rows += [rows[3], (None, *rows[6][1:]), (None, *rows[16][1:])]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def plain_words(t):
    return WORD.findall((t or "").translate(str.maketrans(UPPER, LOWER)))


def test_quality(docs, empty):
    rows = quality.op9_quality_rules(docs).collect()
    texts = {i: t for i, t in enumerate(some_texts())}
    assert len(rows) == docs.count()
    for r in rows:
        if r.doc_id is None:
            continue
        w = WORD.findall(texts[r.doc_id] or "")
        grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        hit = {i + k for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for k in range(5)}
        lines = [x for x in (texts[r.doc_id] or "").split("\n") if WORD.search(x)]
        assert (r.n_words, r.word_chars, r.n_repeat_words, r.n_dup_lines) == (len(w), sum(map(len, w)), len(hit), len(lines) - len(set(lines)))
        assert r.base_failed == (len(w) < 10 or 100 * len(hit) > 20 * len(w)) and not (r.base_failed and r.kept)
    assert quality.filter_documents(docs).columns == docs.columns
    assert quality.op9_quality_rules(empty).count() == 0


def test_hosts_are_shrunk(spark):
    rows = [("bad", True)] * 40 + [("tiny", True)] + [(f"good{i}", k == 0) for i in range(20) for k in range(20)]
    got = {r.host: r for r in quality.host_verdicts(spark.createDataFrame(rows, "h string, f boolean"), "h", "f").collect()}
    assert got["bad"].host_rejected and not got["good3"].host_rejected
    assert got["tiny"].host_rate < got["bad"].host_rate


def test_mixing(docs, empty):
    rows = mixing.op5_mixing(docs).collect()
    again = mixing.op5_mixing(docs.repartition(5)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again)) and len(rows) == docs.count()
    assert all(r.taken <= 3 * r.size and r.target <= 3 * r.source_size for r in rows)
    total, targets = sum(r.size for r in rows), {(r.source_size, r.target) for r in rows}
    assert abs(sum(t for _, t in targets) - total) < 1e-6
    assert mixing.op5_mixing(empty).count() == 0 and mixing.repeat_documents(docs).columns == docs.columns


def test_water_filling(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 100), ("c", 1000), (None, 0)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(sizes).collect()}
    assert got == {"a": 30.0, "b": 300.0, "c": 780.0, None: 0.0}


def test_urls(spark):
    seen = ["https://WWW.Example.com/en/1?q", "http://a.example.com/en/2", "http://x.com/", "http://x.com", "http://z.net/es/#f", "no scheme", None, "a://b://c/d", "http://z.net/de/3"]
    pages = spark.createDataFrame([(i, u, "h", "d") for i, u in enumerate(seen)], "page_id long, url string, host string, row string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, None), (2, 1, 0), (3, 1, 0), (9, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.op1_url_filters(pages, labels).collect()}
    assert got == {0: ("www.example.com", "/en/1", "www.example.com/en/", "allow"), 1: ("a.example.com", "/en/2", "example.com/en/", "block"),
                   2: ("x.com", "/", "com/", "allow"), 3: ("x.com", "", None, "allow"), 4: ("z.net", "/es/", "net/es/", "block"),
                   5: ("", "", None, "allow"), 6: ("", "", None, "allow"), 7: ("b:", "//c/d", None, "allow"), 8: got[8]}
    assert urls.op1_url_filters(pages.limit(0), labels).count() == 0
    assert urls.op1_url_filters(pages, labels.limit(0)).where("verdict = 'block'").count() == 2


def test_reputation_blocks_bad_hosts(spark):
    hosts = [("evil.a.org", 1, 60), ("evil.a.org", 0, 5), ("fine.b.org", 0, 80), ("fine.b.org", 1, 3), ("new.a.org", None, 1)]
    outcomes = spark.createDataFrame([(h, b) for h, b, n in hosts for _ in range(n)], "host string, bad int")
    got = {r.host: r for r in urls.host_reputation(outcomes, outcomes).collect()}
    assert got["evil.a.org"].blocked and not got["fine.b.org"].blocked and got["new.a.org"].n_labelled == 0
    assert got["new.a.org"].rate > got["fine.b.org"].rate  # falls back to its domain


def link_groups(texts, size):
    sets = [frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset() for w in map(plain_words, texts)]
    root = list(range(len(texts)))
    for _ in root:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= 80 * len(a | b):
                    root[i] = root[j] = min(root[i], root[j])
    return sets, root


def test_near_duplicates(spark, docs, empty):
    r = random.Random(9)
    words = [f"w{r.randint(0, 40)}" for _ in range(60)]
    texts = some_texts()
    for k in range(40):  # a chain of near copies around the threshold, short sets among them
        near = words[: r.choice([3, 5, 8, 60])].copy()
        for _ in range(r.randint(0, max(1, len(near) // 12))):
            near[r.randrange(len(near))] = f"v{r.randint(0, 3)}"
        texts.append(" ".join(near))
    sets, root = link_groups(texts, 2)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for x in neardup.op6_minhash_near_dedup(df).collect():
        assert (x.n_shingles, x.component_id, x.kept) == (len(sets[x.doc_id]), root[x.doc_id], root[x.doc_id] == x.doc_id)
    kept = neardup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    sets, root = link_groups(some_texts(), 5)
    want = {i for i, k in enumerate(root) if i == k}
    got = [x.doc_id for x in kept.collect()]
    assert sorted(got) == sorted(want)  # repeated rows and null ids that copy others are gone
    assert neardup.drop_near_duplicates(empty).count() == 0 and neardup.op6_minhash_near_dedup(empty).count() == 0


def test_registers_estimate_similarity():
    r = np.random.default_rng(3)
    a = np.unique(r.integers(0, 2**63, 6000, dtype=np.uint64) * np.uint64(2))
    for share in (0.5, 0.8, 0.95):
        b = np.unique(np.concatenate((a[: int(len(a) * share)], r.integers(0, 2**63, int(len(a) * (1 - share)), dtype=np.uint64) * np.uint64(2) + np.uint64(1))))
        truth = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        same = (neardup.registers(a) == neardup.registers(b)).mean()
        by_chance = neardup.chance(np.array([float(len(a))]), np.array([float(len(b))]))[0]
        assert abs((same - by_chance) / (1 - by_chance) - truth) < 0.12


@pytest.mark.parametrize("crowd", [3000, 1])
def test_repeated_strings(docs, empty, crowd, monkeypatch):
    monkeypatch.setattr(substrings, "CROWD", crowd)
    rows = docs.select("doc_id", "text").collect()
    count = Counter()
    for r in rows:
        raw = (r.text or "").encode()
        count.update(raw[i : i + 200] for i in range(len(raw) - 199))

    def want(text):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - 199):
            if count[raw[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        return len(raw), sum(gone), len(re.findall(b"\x01+", gone)), hashlib.sha256(bytes(b for b, g in zip(raw, gone) if not g)).hexdigest()

    got = substrings.op3_suffix_array_dedup(docs).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == Counter((r.doc_id, *want(r.text)) for r in rows)
    assert substrings.op3_suffix_array_dedup(empty).count() == 0


def test_suffix_sorting(monkeypatch):
    r = random.Random(3)
    for _ in range(400):
        monkeypatch.setattr(substrings, "SPAN", r.choice([1, 2, 3, 5, 8]))
        n, letters = substrings.SPAN, bytes(r.sample([0, 97, 98, 99, 244], r.randint(1, 4)))
        pieces = [bytes(r.choice(letters) for _ in range(r.randint(n, n + 20))) for _ in range(r.randint(1, 6))]
        count = Counter(p[i : i + n] for p in pieces for i in range(len(p) - n + 1))
        assert [x.tolist() for x in substrings.repeated_starts(pieces)] == [[count[p[i : i + n]] > 1 for i in range(len(p) - n + 1)] for p in pieces]


def test_decontamination(spark, docs, empty):
    r = random.Random(7)
    item = lambda n: [f"b{r.randint(0, 300)}" for _ in range(n)]
    items = {k: item(n) for k, n in enumerate([3, 5, 15, 40, 59, 120, 450])}
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()] + [(90, None), (91, "")], "item_id long, text string")
    texts, want = [], set()
    for k, w in items.items():
        for at in (0, 7, 300):
            want.add((len(texts), k))
            texts.append(" ".join(item(at) + [x.upper() for x in w] + item(11)))
    near = items[4].copy()
    near[10] = "edit"
    want.add((len(texts), 4))
    texts.append(" ".join(item(60) + near + item(60)))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(x.doc_id, x.item_id): x for x in decontaminate.op2_decontamination(df, bench).collect()}
    assert set(got) == want and got[len(texts) - 1, 4].similarity >= 0.8 and got[4, 1].first_word == 7
    assert decontaminate.op2_decontamination(docs, bench).count() == 0
    assert sorted(map(str, decontaminate.drop_contaminated(docs, bench).collect())) == sorted(map(str, docs.collect()))
    assert decontaminate.op2_decontamination(empty, bench).count() == 0 and decontaminate.drop_contaminated(df, bench.limit(0)).count() == len(texts)


def test_decontamination_misses_nothing(monkeypatch):
    """Items of random sizes, repeated words among them, copied at random offsets with random edits, against all windows."""
    r, shared = random.Random(11), decontaminate.SHINGLE
    items = [[f"b{r.randint(0, r.choice([3, 40, 4000]))}" for _ in range(r.choice([3, 5, 6, 14, 20, 33, 55, 64, 90, 130, 190, 230, 410]))] for _ in range(60)]
    items += [items[5][:-1] + ["other"], items[9][2:], ["x"] * 30, ["x", "y"] * 20]
    index = decontaminate.build_index([(k, " ".join(w)) for k, w in enumerate(items)])
    noise = lambda n: [f"n{r.randint(0, 9)}" for _ in range(n)]
    texts = [["x"] * 25, ["x"] * 90, ["y", "x"] * 30, [], ["b1"]]
    for w in items * 2:
        w = w.copy()
        for _ in range(r.choice([0, 0, 1, 1, 2, len(w) // 45, len(w) // 30])):
            at = r.randrange(len(w))
            w[at : at + r.randint(0, 2)] = noise(r.randint(0, 2))
        cut = r.choice([0, 0, 0, len(w) // 12])
        texts.append(noise(r.choice([0, 3, 61])) + w[cut:] + noise(r.choice([0, 0, 17])))
    for w in [w for w in items if 50 < len(w) < 200] * 4:  # similarities just above the threshold
        w = w.copy()
        for at in r.sample(range(5, len(w) - 5), len(w) // 45):
            w[at] = "edit"
        texts.append(noise(r.randint(0, 90)) + w + noise(r.randint(20, 90)))
    shingles = lambda w: [tuple(w[i : i + shared]) for i in range(max(1, len(w) - shared + 1))] if w else []

    def want(text):
        out = {}
        for k, item in enumerate(items):
            cuts = -(-len(item) // decontaminate.LONGEST)
            for piece in {tuple(p) for p in [item, *np.array_split(item, cuts)]}:
                bag, n = Counter(shingles(piece)), min(len(piece), len(text))
                if not set(shingles(text[:])) & set(bag) and len(piece) >= shared:
                    continue
                for at in range(len(text) - n + 1):
                    mine = Counter(shingles(text[at : at + n]))
                    both = (mine & bag).total()
                    score = both / max(1, mine.total() + bag.total() - both)
                    if score >= decontaminate.SIMILARITY:
                        out[k] = max(out.get(k, (0, 0)), (score, -at))
        return {k: (score, -at) for k, (score, at) in out.items()}

    wanted = [want(t) for t in texts]
    lines = [" ".join(w) for w in texts]
    got = decontaminate.matches(lines, index)
    missed = [(t, k) for t, x in enumerate(wanted) for k in x if k not in got[t]]
    assert not missed and got == wanted and sum(map(len, wanted)) > 120
    monkeypatch.setattr(decontaminate, "BYTES_AT_ONCE", 600)  # many batches, long texts in runs
    monkeypatch.setattr(decontaminate, "PAIRS_AT_ONCE", 3)
    assert decontaminate.matches(lines, index) == wanted


def test_hamming_search_is_complete():
    r = np.random.default_rng(1)
    texts = [(i, " ".join(f"w{x}" for x in r.integers(0, 99, 30))) for i in range(50)]
    c = decontaminate.build_index(texts).classes[0]
    flips = np.array([np.bitwise_or.reduce(np.uint64(1) << r.choice(64, decontaminate.RADIUS, replace=False).astype(np.uint64)) for _ in c.prints], np.uint64)
    windows, items = decontaminate.within_radius(c.prints ^ flips, c)
    assert {(i, i) for i in range(len(c.prints))} <= set(zip(windows.tolist(), items.tolist(), strict=True))


def test_decontamination_goes_by_simhash(monkeypatch):
    """Bags at similarity 0.8 and above, repeats among them, are near; others are not; what is not near is not found."""
    r = random.Random(3)
    worst = 0
    for n in [4, 5, 9, 10, 12, 20, 46, 91, 196] * 20:
        lost = next(d for d in range(n, -1, -1) if (n - d) >= 0.8 * (n + d))
        bag = [r.getrandbits(64) if r.random() < 0.7 else r.randint(1, 3) for _ in range(n)]
        other = bag[lost:] + [r.choice([r.getrandbits(64), 7]) for _ in range(lost)]
        r.shuffle(other)
        short = bag[: -(-8 * n // 10)]
        for x in (other, short):
            a, b = (decontaminate.window_prints(np.array(s, np.uint64), len(s))[0] for s in (bag, x))
            worst = max(worst, int(np.bitwise_count(a ^ b).sum()))
    assert 30 < worst <= decontaminate.NEAR - 10
    s = np.array([r.choice([r.getrandbits(64), 5, 6]) for _ in range(90)], np.uint64)
    direct = [decontaminate.window_prints(s[i : i + 30], 30)[0].tolist() for i in range(61)]
    assert decontaminate.window_prints(s, 30).tolist() == direct
    noise = lambda n: [f"n{r.randint(0, 999)}" for _ in range(n)]
    item = noise(60)
    index, text = decontaminate.build_index([(1, " ".join(item))]), " ".join(noise(80) + item + noise(5))
    monkeypatch.setattr(decontaminate, "WINDOWS_AT_ONCE", 9)
    assert decontaminate.matches([text], index) == [{1: (1.0, 80)}]
    monkeypatch.setattr(decontaminate, "NEAR", -1)
    assert decontaminate.matches([text], index) == [{}]


def test_language(spark, docs, empty):
    r = random.Random(2)
    make = lambda parts, n: " ".join("".join(r.choice(parts) for _ in range(r.randint(1, 3))) for _ in range(n)).capitalize() + "."
    parts = {"xx": ["tion", "the", "ing", "ea"], "yy": ["ung", "sch", "ver", "ü"], "zz": ["eau", "è", "que", "oi"]}
    rows = [(i, make(parts[k], 60), k) for i, k in enumerate(list(parts) * 60)] + [(900, None, "xx"), (901, " 12 ?", "yy"), (902, "中文", None), (None, "the ing", "xx")]
    got = {x.doc_id: x for x in language.op4_language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, *_ in rows if i is not None) and not got[None].held_out
    assert all(got[i].lang_pred == k and 0.5 <= got[i].score <= 1 for i, _, k in rows[:180])
    assert [got[i].lang_pred for i in (900, 901)] == ["und"] * 2 and got[900].score == 0 and got[902].lang_pred in parts
    assert language.op4_language_id(docs).count() == docs.count() and language.op4_language_id(empty).count() == 0


def test_cross_parsing_matches_brute_force():
    r = random.Random(6)
    sample = {k: ["".join(r.choice(k + "ab ") for _ in range(300))] for k in "xyz"}
    model = language.fit(sample)
    for _ in range(40):
        text = "".join(r.choice("abxyzq ") for _ in range(r.randint(1, 250)))
        s = language.symbols_of(text, model.symbols)
        for j, k in enumerate(model.langs):
            known = bytes(language.symbols_of(sample[k][0], model.symbols).tolist())
            n, at = 0, 0
            while at < len(s):
                end = at + 1
                while end <= len(s) and bytes(s[at:end].tolist()) in known:
                    end += 1
                n, at = n + 1, max(at + 1, end - 1)
            assert language.phrases(model, [s])[0, j] == n


def test_edited_counts(docs, empty):
    pieces, r = counts.pieces_of(counts.default_tokenizer()), random.Random(5)
    letters = ["a", "b", " ", "  ", "\n", "'s", "!", "1", "é", " \n", "中", "\t"]
    for _ in range(300):
        text = "".join(r.choice(letters) for _ in range(r.randint(0, 400)))
        tree = counts.CountTree(text, pieces)
        for _ in range(4):
            a = r.randint(0, len(text) + 2)
            b, insert = a + r.randint(0, 9), "".join(r.choice(letters) for _ in range(r.randint(0, 8)))
            tree.edit(a, b, insert)
            text = text[:a] + insert + text[b:]
            assert tree.tokens == len(pieces.tokenizer.encode(text, add_special_tokens=False)) and tree.text == text
    rows = counts.op7_token_counts(docs).collect()
    texts = dict(enumerate(some_texts()))
    assert all(x.n_tokens == len(pieces.tokenizer.encode(texts[x.doc_id] or "", add_special_tokens=False)) for x in rows if x.doc_id is not None)
    after = {}
    for x in docs.select("doc_id", "text", counts.revision_of(F.col("doc_id"), F.col("text")).alias("edits")).collect():
        text = x.text or ""
        for e in x.edits:
            start = min(max(e["start"] or 0, 0), len(text))
            text = text[:start] + e["insert"] + text[max(start, e["stop"] or 0) :]
        after.setdefault(x.doc_id, []).append((len(pieces.tokenizer.encode(text, add_special_tokens=False)), len(text)))
    got = {}
    for x in rows:
        got.setdefault(x.doc_id, []).append((x.n_tokens_after, x.n_chars_after))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in after.items()}
    assert counts.op7_token_counts(empty).count() == 0
    odd = docs.select("text", F.expr("from_json('[null, {\"stop\": 5}, {\"start\": -3, \"stop\": 2, \"insert\": \"x\"}]', 'array<struct<start:int,stop:int,insert:string>>')").alias("edits"))
    assert counts.count_tokens(odd.union(odd.select("text", F.lit(None).cast(odd.schema["edits"].dataType)))).count() == 2 * docs.count()


def test_token_table(spark, docs, empty, tmp_path):
    from tokenizers import Tokenizer

    tokenizer, rows = Tokenizer.from_file(tokens.default_tokenizer()), docs.select("doc_id", "text").collect()
    tokens.write_tokens(docs, f"{tmp_path}/t")
    got = sorted(tokens.read_tokens(spark, f"{tmp_path}/t").collect(), key=lambda x: x.start)
    want = sorted(rows, key=lambda x: (x.doc_id is not None, x.doc_id or 0, x.text is not None, (x.text or "").encode()))
    start = 0
    for x, r in zip(got, want, strict=True):
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1]
        assert (x.doc_id, x.start, x.n_tokens, x.ids) == (r.doc_id, start, len(ids), ids)
        assert x.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    assert tokens.op8_token_ids(empty).count() == 0


def test_words_remember_stems_alone():
    """All that a worker keeps between lots are stems, within their bound: no chunk with marks, no chunk twice."""
    words, r = tokens.Words(tokens.default_tokenizer()), random.Random(9)
    words.stems.bound = 20
    texts = [" ".join("".join(r.choice("abcé") for _ in range(5)) + r.choice(["", ".", "?!"]) for _ in range(30)) for _ in range(40)]
    for t in texts:
        assert next(iter(words.encode([t]))).tolist() == [*words.tokenizer.encode(t, add_special_tokens=False).ids, 1]
    held = [v for v in vars(words).values() if hasattr(v, "young")]
    assert held == [words.stems] and len(words.stems.young) + len(words.stems.old) <= 2 * 50
    assert not any(c in "".join([*words.stems.young, *words.stems.old]) for c in ".?!")


def test_words_match_whole_texts():
    from tokenizers import Tokenizer

    tokenizer, r = Tokenizer.from_file(tokens.default_tokenizer()), random.Random(8)
    letters = ["a", "B", "É", "e\u0301", "\u0958", " ", "\n", "\t", ".", "?!", "'S", "'re", "1", "Σ", "İ", "中", "|", "<|endoftext|>", "<|", "\u00a0"]
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 30))) for _ in range(1500)]
    for t, ids in zip(texts, tokens.words_of(tokens.default_tokenizer()).encode(texts), strict=True):
        assert ids.tolist()[:-1] == tokenizer.encode(t, add_special_tokens=False).ids, t


def test_secrets(spark, docs, empty):
    body = "A1b2C3d4E5f6G7h8I9j0K1l2M3n4O5"
    good, wrong = f"ghp_{body}{secrets.base62_crc(body)}", f"ghp_{body}AAAAAA"
    r = random.Random(1)
    bits = ["password", "API_KEY", "apikey", "token", "Secret=", ":", "=", " ", '"', "'", "abcdef", "AKIA", "0123456789abcdef", "ABCDEFGHIJ123456", "é", "ſecret", "\u212a", "\n", good, wrong, "npm_"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 25))) for _ in range(1500)] + [None]
    kinds = [(secrets.ASSIGN, lambda m: len(m[2]) >= 6), (secrets.ACCESS, lambda m: len(m[0]) >= 20), (re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24)]
    for t in texts:
        want = sorted((m.start(), k, m.end()) for k, (p, ok) in enumerate(kinds) for m in p.finditer(t or "") if ok(m))
        got = secrets.find_secrets(t)
        assert [(s, secrets.KINDS.index(k), e) for s, e, k in got if k in secrets.KINDS[:3]] == want
    assert ("github" in {k for *_, k in secrets.find_secrets(good)}) and "github" not in {k for *_, k in secrets.find_secrets(wrong)}
    got = secrets.op10_secret_scans(spark.createDataFrame([(1, f"x {good}"), (2, None)], "doc_id long, text string")).collect()
    assert {(x.doc_id, x.n_github, x.base_sha256 == hashlib.sha256(b"").hexdigest()) for x in got} == {(1, 1, True), (2, 0, True)}
    assert secrets.op10_secret_scans(docs).count() == docs.count() and secrets.op10_secret_scans(empty).count() == 0
