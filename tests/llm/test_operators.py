"""Every training-data operator against a plain Python version, on awkward rows and on a small table."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from graphloom.llm import decontamination, exact_dedup, lm_scoring, packing, pii, queries, simhash, token_counts, tokens, toxicity, url_filters, warc
from graphloom.llm.common import keep_decided, materialise

SMALL = "/root/testdata/sf0.001"
LONG = "word soup " * 30_000
ROWS = [
    (1, "Hello there, General Kenobi! How are you today?"),
    (2, "hello there, general kenobi! how are you today?"),
    (3, None),
    (4, ""),
    (5, LONG),
    (6, "one two"),
    (6, "one two"),
    (None, "one two"),
    (None, None),
    (7, "   \t\n  "),
    (8, "Ünïcödé ñandú ß İstanbul 日本語 テキスト 🙂 e\u0301 \u00a0 x\u2003y"),
    (9, "<|endoftext|> and <|startoftext|> in a text<|endoftext|>"),
    (10, "a\n\nb  c \n d\te\r\nf   "),
    (11, "x" * 5000 + "@" + "1" * 3000),
    (12, "it's they'll I'd we're 's 'T don''t 3.14 a1b2 1,000"),
]
SCHEMA = "doc_id long, text string, text_key string, digest int, fp string, n int, key string, length long, __salt int, kept string"


@pytest.fixture(scope="module")
def rough(spark):
    return spark.createDataFrame([(i, t, "k", 1, "f", 2, "y", 3, 4, "no") for i, t in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def ordered(rows):
    return sorted(rows, key=repr)


# ---- exact deduplication


def low(text):
    return (text or "").encode().lower()


@pytest.mark.parametrize("counters", [2, 256])
def test_exact_dedup(spark, rough, docs, counters):
    hot = spark.createDataFrame([(100 + i, "Hot TEXT" if i % 2 else "hot text") for i in range(40)], "doc_id long, text string")
    for table in (rough, docs, rough.select("doc_id", "text").unionByName(hot)):
        groups = defaultdict(list)
        for i, t in pairs(table):
            groups[low(t)].append(i)
        want = []
        for t, ids in groups.items():
            keep = max((i for i in ids if i is not None), default=None)
            h = hashlib.sha256(t).hexdigest()
            first = True
            for i in sorted(ids, key=lambda i: (i is None, -(i or 0))):
                want.append((i, keep, len(ids), first and i == keep, h))
                first = first and not (i == keep)
        got = [(r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["digest"].hex()) for r in exact_dedup.exact_dedup(table, counters=counters).collect()]
        assert ordered(got) == ordered(want)


def test_misra_gries_keeps_heavy_hitters(spark):
    rows = [(i, b"hot" if i % 3 == 0 else str(i).encode()) for i in range(3000)]
    keyed = spark.createDataFrame(rows, "doc_id long, digest binary").repartition(5)
    found = [bytes(r["digest"]) for r in exact_dedup.frequent_digests(keyed, 8).collect()]
    assert b"hot" in found and len(found) <= 8


def test_keep_decided_keeps_one_of_equal_rows(spark, rough):
    kept = keep_decided(rough, exact_dedup.exact_dedup(rough).select("doc_id", "text_key", "kept"))
    assert kept.columns == rough.columns
    assert len({low(t) for _, t in ROWS}) == kept.count() == len({low(t) for _, t in pairs(kept)})


# ---- near deduplication


def plain_fingerprint(text):
    w = low(text).split()
    grams = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(rows):
    fp = [plain_fingerprint(t) for _, t in rows]
    top = list(range(len(rows)))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            if (fp[a] ^ fp[b]).bit_count() <= 2:
                top[root(a)] = root(b)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[root(i)].append(d)
    return [(d, f"{fp[i]:016x}", min((x for x in least[root(i)] if x is not None), default=None)) for i, (d, _) in enumerate(rows)]


def test_simhash_against_all_pairs(spark, rough, docs):
    for table in (docs, rough.select("doc_id", "text").withColumn("text", F.left("text", F.lit(5000)))):
        found = simhash.near_duplicates(table)
        got = [(r["doc_id"], f"{r['fp'] & (1 << 64) - 1:016x}", r["component_id"]) for r in found.collect()]
        assert ordered(got) == ordered(plain_components(pairs(table)))


def test_simhash_links_chains_of_fingerprints(spark):
    chain, x = [], 0
    for k in range(40):  # every neighbour is two bits away, the ends are far apart
        chain.append((1000 - k, x if x < 1 << 63 else x - (1 << 64), k))
        x ^= 3 << (2 * (k % 31))
    far = [(5000 + k, random.Random(k).getrandbits(63), k) for k in range(50)]
    fps = spark.createDataFrame(chain + far, "doc_id long, fp long, text_key long")
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_components(materialise(fps)).collect()}
    assert {got[d] for d, _, _ in chain} == {min(d for d, _, _ in chain)}
    assert all(got[d] == d for d, _, _ in far)


def test_one_of_each_component_stays(spark, rough):
    found = materialise(simhash.near_duplicates(rough))
    kept = [r for r in simhash.one_of_each(found).collect() if r["kept"]]
    assert len(kept) == found.select("root").distinct().count()


# ---- tokens


def test_token_counts_equal_the_library(spark, rough, docs):
    path = queries.vocabulary("byte_bpe_50k.json")
    whole = tokens.load(path)
    for table in (rough, docs):
        got = [(r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts.token_counts(table, path).collect()]
        n = lambda t: len(whole.encode(t or "", add_special_tokens=False).ids)
        assert ordered(got) == ordered([(i, len((t or "").encode()), n(t), n(t) > 512) for i, t in pairs(table)])


def test_pieces_on_random_texts():
    rng = random.Random(3)
    alphabet = [*"abz AZ09  \n\n\t.,'!-_éßñ\u00a0\u2003日\u0301İ", " the", "'s", "'ll", "<|endoftext|>", "..."]
    lengths, words = tokens.PieceLengths(queries.vocabulary("byte_bpe_50k.json")), tokens.WordIds(queries.vocabulary("word_bpe_49k.json"))
    for _ in range(3000):
        t = "".join(rng.choices(alphabet, k=rng.randint(0, 30)))
        assert lengths.count(t) == len(lengths.whole.encode(t, add_special_tokens=False).ids), repr(t)
        ids = words.whole.encode(t, add_special_tokens=False).ids
        assert words.ids(t.encode()) == b"".join(i.to_bytes(4, "little") for i in ids), repr(t)


def test_packing(spark, rough, docs):
    path = queries.vocabulary("word_bpe_49k.json")
    whole = tokens.load(path)
    for table, run_rows in ((rough, 2), (docs, 1_000_000), (docs, 3)):
        rows = packing.pack(materialise(packing.pieces(table, path)), run_rows=run_rows).collect()
        want = []
        for i, t in pairs(table):
            ids = whole.encode(t or "", add_special_tokens=False).ids + [0]
            for k in range(0, len(ids), 2048):
                part = ids[k : k + 2048]
                want.append((i, k // 2048, k, len(part), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))))
        assert ordered((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == ordered(want)
        bins = defaultdict(list)
        for r in rows:
            bins[r["sequence_id"]].append((r["offset"], r["length"]))
        for held in bins.values():
            at = 0
            for offset, length in sorted(held):
                assert offset == at
                at += length
            assert at <= 2048
        assert len(bins) == plain_best_fit([r["length"] for r in rows])


def plain_best_fit(lengths, limit=2048):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fit = min((g for g in gaps if g >= n), default=None)
        if fit is None:
            gaps.append(limit - n)
        else:
            gaps[gaps.index(fit)] = fit - n
    return len(gaps)


def test_best_fit_rounds_equal_best_fit_decreasing():
    rng = random.Random(5)
    for _ in range(200):
        lengths = [rng.choice([rng.randint(1, 64), rng.randint(1, 8), 64]) for _ in range(rng.randint(1, 120))]
        counts = {n: lengths.count(n) for n in set(lengths)}
        places = sorted(packing.best_fit_rounds(counts, 64))
        used = defaultdict(list)
        for k, (n, rank, first, offset) in enumerate(places):
            end = places[k + 1][1] if k + 1 < len(places) and places[k + 1][0] == n else counts[n]
            for r in range(rank, end):
                used[first + r - rank].append((offset, n))
        assert sum(map(len, used.values())) == len(lengths) and len(used) == plain_best_fit(lengths, 64)
        for held in used.values():
            assert [o for o, _ in sorted(held)] == [sum(n for _, n in sorted(held)[:k]) for k in range(len(held))]


# ---- web archives


def test_warc_round_trip(spark, tmp_path):
    fake = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    inner = warc.record(99, "http://in/", b"p" * 50, "00", None, "2020-01-01T00:00:00Z").decode()
    body = ["", None, "x" * 999, "y" * 1000, "y" * 1000, "y" * 1000, fake * 40, inner * 30, "é" * 700, "é" * 700, "WARC/1.1\r\n" * 300, "z" * 50_000, "small", "small"]
    rows = [(i, f"http://h/{i}\r\nX: y", t, "extra") for i, t in enumerate(body)] + [(None, None, "y" * 1000, "e"), (5, "u", "y" * 1000, "e")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string").repartition(3)
    for split in (100, 1000, 8 << 20):
        files = warc.write_archives(pages, f"file://{tmp_path}/w{split}", file_bytes=20_000)
        got = [(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.read_archives(files, split).collect()]
        want = []
        for i, _, t, _ in rows:
            raw = (t or "").encode()
            same = [j for j, _, u, _ in rows if (u or "").encode() == raw and j is not None]
            again = len(raw) >= 1000 and i != max(same)
            want.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", max(same) if again else None))
        assert ordered(got) == ordered(want)


# ---- toxicity


def test_toxicity_on_held_out_labels(spark):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    found = toxicity.toxicity(spark.read.parquet(f"{d}/documents.parquet"), labels)
    rows = found.where("held_out").join(labels, "doc_id").select("predicted", "toxic", "score").collect()
    assert sum(r["predicted"] == r["toxic"] for r in rows) >= 0.93 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in rows)
    bad, good = ([r["score"] for r in rows if r["toxic"] == k] for k in (1, 0))
    assert sum((a > b) + 0.5 * (a == b) for a in bad for b in good) > 0.75 * len(bad) * len(good)


def test_toxicity_rough_rows(spark, rough, empty):
    labels = spark.createDataFrame([(1, 1, 1), (1, 1, 0), (2, 1, 0), (None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    for table in (rough, empty):
        for some in (labels, labels.limit(0)):
            rows = toxicity.toxicity(table, some).collect()
            assert len(rows) == table.count() and all(0 <= r["score"] <= 1 for r in rows)


# ---- decontamination


def plain_words(t):
    return [w for w in re.split(r"[^\w]|_", (t or "").lower()) if w]


def plain_contaminated(rows, items):
    out = []
    for d, t in rows:
        w, hit = plain_words(t), False
        for _, item in items:
            q = plain_words(item)
            n = min(15, len(q))
            if len(q) < 5:
                continue
            for s in range(len(q) - n + 1):
                for at in range(len(w) - n + 1):
                    same = [a == b for a, b in zip(w[at : at + n], q[s : s + n])]
                    hit |= sum(same) >= 0.8 * n and "1" in "".join(map(str, map(int, same)))
        out.append((d, hit))
    return out


def test_decontamination(spark):
    rng = random.Random(11)
    words = [a + b for a in "bcdfgklm" for b in ("a", "e", "io", "u")]
    items = [(k, " ".join(rng.choices(words, k=n))) for k, n in enumerate((3, 5, 7, 9, 15, 30, 40))] + [(7, None), (None, ""), (8, "Caps AND, punctuation! in-a line, which is long enough to count; surely.")]
    texts = []
    for d in range(60):
        body = rng.choices(words, k=rng.randint(0, 80))
        if d % 2:
            q = plain_words(items[rng.choice((1, 2, 3, 4, 5, 6, 9))][1])
            for _ in range(d % 3):
                if len(q) >= 15:  # substitutions spread out
                    q[rng.randrange(len(q))] = "zzz"
            body = body[:20] + q + body[20:]
        texts.append((d, ", ".join(body)))
    texts += [(3, None), (None, items[5][1]), (None, ""), (61, items[9][1].upper())]
    docs = spark.createDataFrame([(*t, 5, "h") for t in texts], "doc_id long, text string, item_id int, hash string")
    bench = spark.createDataFrame([(*t, "w") for t in items], "item_id long, text string, w string")
    got = [(r["doc_id"], r["contaminated"]) for r in decontamination.decontamination(docs, bench).collect()]
    want = plain_contaminated(texts, items)
    missed = [x for x in want if x[1] and x not in got]
    wrong = [x for x in got if x[1] and x not in want]
    assert len(got) == len(texts) and not wrong and not missed
    index, masks = decontamination.benchmark_index(bench)
    some = spark.createDataFrame(texts, "doc_id long, text string").na.fill("")
    one = decontamination.contaminated(some, index, masks)
    many = decontamination.contaminated(some, index, masks, block_rows=20)
    assert ordered(map(tuple, one.collect())) == ordered(map(tuple, many.collect()))
    left = decontamination.remove_contaminated(docs, bench)
    assert left.columns == docs.columns and left.count() == sum(not hit for _, hit in want)
    assert decontamination.decontamination(docs.limit(0), bench).count() == 0
    assert not decontamination.decontamination(docs, bench.limit(0)).where("contaminated").count()


# ---- url filters

URLS = [
    (1, "https://WWW.Example.com/en/a?utm_source=x"), (2, "http://a.example.com/en/"), (3, "http://example.com/de"), (4, "http://x.net/fr/1?ref=q"), (5, "http://x.net"),
    (6, None), (7, ""), (8, "no scheme/en/"), (9, "http://org.org/ads/1"), (10, "http://m.org.org/"), (11, "https://h.org/f.zip"), (12, "https://h.org/casino/"), (13, "http://notcom/"), (14, "http://com/x"),
    (15, "http://h.org?sid=3#x"), (16, "x://y://z.com/"), (17, "http://h.org/preads/adsx"), (1, "http://dup.org/"), (None, "http://n.net/es/1"), (18, "http://H.org/UTM_Source=1?UTM_SOURCE=2"),
]


def plain_url(url):
    host = path = ""
    if url and "://" in url:
        m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1])
        host, path = re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]
    fit = [(r, v) for r, v in url_filters.LIST_RULES if (host == r[: r.index("/")] or host.endswith("." + r[: r.index("/")])) and path.startswith(r[r.index("/") :])]
    rule, verdict = max(fit, key=lambda x: len(x[0]), default=(None, None))
    n = sum(bool(url) and re.search(p, url.lower()) is not None for p in url_filters.PATTERN_RULES)
    return host, path, rule, verdict or ("block" if n else "allow"), n


def test_url_filter(spark):
    pages = spark.createDataFrame([(*r, "h", "p") for r in URLS], "page_id long, url string, host string, n_patterns string")
    got = [tuple(r) for r in url_filters.url_filter(pages).collect()]
    assert ordered(got) == ordered((i, *plain_url(u)) for i, u in URLS)
    assert url_filters.url_filter(pages.limit(0)).count() == 0


def test_rule_tokens_are_whole_tokens():
    assert url_filters.rule_tokens(r"://m\.") == [["m"]]
    assert url_filters.rule_tokens(r"[?&](sid|id)=") == [["sid"], ["id"]]
    assert url_filters.rule_tokens(r"[a-z]ads/") == [[]] and url_filters.rule_tokens(r"/colou?rs/") == [[]]


# ---- personal data

PLAIN = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", r"[0-9](?:[\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]",
)


def plain_spans(text):
    out = []
    for k, p in enumerate(PLAIN):
        for m in re.finditer(p, text or ""):
            digits = re.sub(r"[^0-9]", "", m[0])
            luhn = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(digits[::-1])) % 10 == 0
            ok = (True, k != 1 or all(int(x) <= 255 for x in m[0].split(".")), 13 <= len(digits) <= 19 and luhn, 9 <= len(digits) <= 15)[k]
            if ok:
                out.append((pii.KINDS[k], *m.span()))
    return out


def pii_rows():
    rng = random.Random(17)
    bits = ["a@b.co", "x.y@mail-1.example.com", "%d@e.f", "a@b.c_d@e.f", "1.2.3.4", "1.2.3.4.5.6.7.8", "300.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (784) 555-8120", "+49.30 123456", "+1", "007.0.0.1", " ", "\n", "é", "🙂", "word", "@", "+", ".", "-", "12", "5500000000000004"]
    rows = [(i, "".join(rng.choices(bits, k=rng.randint(0, 12)))) for i in range(300)]
    return rows + [(1, "a@b.co"), (1, "a@b.co"), (None, "1.2.3.4"), (400, None), (401, "1-" * 30_000 + "1"), (402, "a" * 100_000), (403, "1." * 20_000), (404, "+" + "1" * 50_000)]


def test_pii_base_spans(spark):
    rows = pii_rows()
    table = spark.createDataFrame([(*r, "k", 5, "s") for r in rows], "doc_id long, text string, key string, kind int, spans string")
    got = [tuple(r)[:6] for r in pii.personal_data(table).collect()]
    want = []
    for i, t in rows:
        spans = plain_spans(t)
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        want.append((i, *(sum(s[0] == k for s in spans) for k in pii.KINDS), hashlib.sha256(text.encode()).hexdigest()))
    assert ordered(got) == ordered(want)
    listed = {r["doc_id"]: r["spans"] for r in pii.personal_data(table).where("doc_id < 300").collect()}
    for i, t in rows[:300]:
        base = ",".join(x for x in listed[i].split(",") if x and not x.startswith("term"))
        assert base == ",".join(f"{k}:{a}:{b}" for k, a, b in plain_spans(t)) or i == 1
    assert pii.personal_data(table.limit(0)).count() == 0


def plain_disclosing(rows):
    """Terms over the threshold, counted pair by pair."""
    import math

    texts_of, n = [t or "" for _, t in rows], len(rows)
    entities = defaultdict(set)
    for t in set(texts_of):
        for kind, a, b in plain_spans(t):
            value = t[a:b].lower() if kind == "email" else t[a:b] if kind == "ip" else re.sub(r"[^0-9]", "", t[a:b])
            entities[kind, value].add(t)
    words = {t: re.findall(r"[^\W_]+", t) for t in set(texts_of)}
    has = {t: {w.lower() for w in ws} for t, ws in words.items()}
    out = {}
    for held in entities.values():
        df_e = sum(t in held for t in texts_of)
        for term in set().union(*(has[t] for t in held)):
            with_it = [t for t in held if term in has[t]]
            per_text = [frozenset((ws[i - 1].lower() if i else None, ws[i + 1].lower() if i + 1 < len(ws) else None) for i in range(len(ws)) if ws[i].lower() == term) for ws in map(words.get, with_it)]
            if len(term) < 2 or len(with_it) < 2 or len(set(per_text)) < max(2, len(with_it) / 2) or df_e == n:
                continue
            both, df = sum(t in with_it for t in texts_of), sum(term in has[t] for t in texts_of)
            share = math.log2(n * both / (df * df_e)) / math.log2(n / df_e)
            if share >= pii.GENERALISE - 1e-9:
                out[term] = max(out.get(term, 0), share)
    return out


def disclosing_rows():
    rng = random.Random(2)
    common = ["the", "and", "report", "from", "today", "with", "über", "x9"]
    rows = [(i, " ".join(rng.choices(common, k=30))) for i in range(200)]
    # the name is far from the address, two letters or digits will do, and it stands in a text without the address too
    rows += [(200 + i, f"dear zorblatt {w} qi {w} 77120 " + " ".join(rng.choices(common, k=60)) + " boss@corp.example.com") for i, w in enumerate(("today", "with", "and", "from", "report", "the", "x9", "über"))]
    rows += [(250, "only zorblatt today")]
    # near copies of one text prove nothing about its other words
    rows += [(260 + i, f"a lonely plinth stands here mail solo@corp.example.com {'and ' * i}") for i in range(4)]
    rows += [(270 + i, f"a lonely plinth {w} here mail solo@corp.example.com {'and ' * i}") for i, w in enumerate(("stands", "falls", "stands", "stands"), 5)]
    rows += [(300 + i, f"report from today mail user{i}@corp.example.com with the") for i in range(30)]
    return rows + [(206, rows[206][1]), (None, None), (400, "")]


def test_pii_terms_that_disclose(spark):
    rows = disclosing_rows()
    table = spark.createDataFrame(rows, "doc_id long, text string")
    whole = table.selectExpr("doc_id", "coalesce(text, '') AS text")
    spans = materialise(pii.base_spans(pii.matches(whole)))
    got = {r["term"]: r["disclosure"] for r in pii.disclosing(whole, spans).collect()}
    assert got == pytest.approx(plain_disclosing(rows)) and {"zorblatt", "qi", "77120"} <= set(got) and "plinth" not in got and "report" not in got
    out = {r["doc_id"]: (r["spans"], r["n_term"]) for r in pii.personal_data(table).collect()}
    start = rows[200][1].index("zorblatt")
    assert f"term:{start}:{start + 8}" in out[200][0] and out[250][1] == 1 and out[200][1] == 3
    assert all(n == 0 for d, (_, n) in out.items() if d is not None and (d < 200 or d >= 260))
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(table).collect()}
    assert "zorblatt" not in clean[200] + clean[250] and "[EMAIL]" in clean[200] and "boss@" not in clean[200] and clean[0] == rows[0][1] and clean[300].startswith("report from today mail [EMAIL] with")


def test_pii_terms_planted_in_the_documents(spark, docs):
    names = spark.createDataFrame([(10_000 + i, f"Regarding {w} Vantongeren, {w} account 5531907: call +44 20 7946 0958 {w}.") for i, w in enumerate(("soon", "late", "again", "never"))], "doc_id long, text string")
    found = pii.personal_data(docs.select("doc_id", "text").unionByName(names)).where("n_term > 0").collect()
    assert {r["doc_id"] for r in found} == {10_000, 10_001, 10_002, 10_003} and all(r["n_term"] >= 2 and r["n_phone"] == 1 for r in found)


# ---- language model


def test_lm_scores(spark, rough, empty):  # more in test_lm.py
    rng = random.Random(9)
    model = {w: rng.sample([f"w{i}" for i in range(30)], 3) for w in (f"w{i}" for i in range(30))}
    rows = []
    for d in range(300):
        w = ["w0"]
        for _ in range(150):
            w.append(rng.choice(model[w[-1]]))
        rows.append((d, " ".join(w)))
    shuffled = [(1000 + d, " ".join(rng.sample(t.split(), 151))) for d, t in rows[:20]]
    out = {r["doc_id"]: r for r in lm_scoring.lm_scores(spark.createDataFrame(rows + shuffled, "doc_id long, text string")).collect()}
    assert all(out[d]["n_tokens"] == 151 and out[d]["log_likelihood"] < 0 for d in range(300))
    assert sum(out[d]["log_likelihood"] > out[1000 + d]["log_likelihood"] for d in range(20)) >= 18
    rows = lm_scoring.lm_scores(rough).collect()
    assert len(rows) == len(ROWS) and all((r["mean_log_likelihood"] is None) == (r["n_tokens"] == 0) for r in rows)
    assert lm_scoring.lm_scores(empty).count() == 0


# ---- empty tables


def test_empty_tables(empty):
    path = queries.vocabulary("word_bpe_49k.json")
    assert exact_dedup.exact_dedup(empty).count() == 0
    assert simhash.near_duplicates(empty).count() == 0
    assert token_counts.token_counts(empty, queries.vocabulary("byte_bpe_50k.json")).count() == 0
    assert packing.best_fit_packing(empty, path).count() == 0


def test_empty_archive(spark):
    assert warc.warc_round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
