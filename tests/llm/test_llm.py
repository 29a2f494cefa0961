"""Operators against brute force on small fixtures, with the edge cases their docstrings define."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")
from tidepool.llm import decontaminate, exact_dedup, html_extract, mixing, ngram_join, pii, sharding, token_counts, token_store, toxicity  # noqa: E402
from tidepool.llm.queries import ORACLES, tokenizer_file  # noqa: E402
from tidepool.llm.transducer import MergeCounter, Pretokenizer, Pretokens  # noqa: E402

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
TEXTS = [None, "", " \n\t", "a b", "a b", "A  B!", "one two three four five six", "x" * 4000 + " 'll'r'", "a<|endoftext|>b <|endoftext|>", "mail me at a@b.c_d@e.f, 1.2.3.4.5.6.7.8 or 4111 1111 1111 1111, +1 (621) 555-4974"]


@pytest.fixture(scope="module")
def docs(spark):
    real = spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()
    rows = [tuple(r) for r in real] + [(10_000 + i, t, "en", "s" if i % 2 else None, 1) for i, t in enumerate(TEXTS)]
    rows += [(None, "no id", "en", "s", 1), (10_003, "a b", "en", "s", 1), (10_003, "a b", "en", "s", 1)]
    return spark.createDataFrame(rows, SCHEMA).withColumnRenamed("n_chars", "n_chars").cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_file())


def test_pretokens_and_counts_equal_the_library():
    rng, lib, machine, counter = random.Random(3), library(), Pretokenizer(chunk=7), MergeCounter(tokenizer_file())
    texts = ["".join(rng.choice(" \n\t'srtevmld1é!a中<|>") for _ in range(rng.randint(0, 80))) for _ in range(200)]
    p = Pretokens(machine, texts)
    n = np.bincount(p.text, weights=[counter.count(p.data[a:b]) for a, b in zip(p.start, p.stop, strict=True)], minlength=len(texts))
    assert n.astype(int).tolist() == [len(e.ids) for e in lib.encode_batch(texts, add_special_tokens=False)]


def test_state_maps_compose():
    machine = Pretokenizer()
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 11, (5, 1), dtype=np.uint8), rng.integers(0, 11, (9, 1), dtype=np.uint8)
    whole = machine.state_maps(np.concatenate([a, b]))
    assert machine.map_product[machine.state_maps(a)[0], machine.state_maps(b)[0]] == whole[0]


def test_token_counts(docs, empty):
    lib = library()
    got = Counter(map(tuple, token_counts.count_tokens(docs, tokenizer_file()).collect()))
    want = Counter((r.doc_id, len((r.text or "").encode()), n := len(lib.encode(r.text or "", add_special_tokens=False).ids), n > 512) for r in docs.collect())
    assert got == want
    assert token_counts.count_tokens(empty, tokenizer_file()).count() == 0


def test_token_store_round_trip(docs, empty):
    lib = library()
    path = token_store.token_ids(docs, tokenizer_file())
    rows = sorted(path.collect(), key=lambda r: r.start)
    at = 0
    for r in rows:
        assert r.start == at
        at += r.n_tokens
    ids = [r.doc_id for r in rows]
    assert ids == sorted(ids, key=lambda x: -1 if x is None else x)
    encoded = [(r.doc_id, [*lib.encode(r.text or "", add_special_tokens=False).ids, 0]) for r in docs.collect()]
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows) == Counter((d, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for d, x in encoded)
    assert token_store.token_ids(empty, tokenizer_file()).count() == 0


def oracle(docs, sql):
    import duckdb

    con = duckdb.connect()
    documents = docs.toArrow()  # noqa: F841
    con.register("documents", documents)
    return con.sql(sql).fetchall()


def test_exact_dedup(docs, empty, spark, tmp_path):
    got = exact_dedup.exact_duplicates(docs).collect()
    assert Counter(map(tuple, got)) == Counter(oracle(docs, ORACLES["op5_exact_dedup"]))
    assert exact_dedup.exact_duplicates(empty).count() == 0
    index = f"file://{tmp_path}/index"
    exact_dedup.exact_duplicates(docs, index).count()
    later = spark.createDataFrame([(99_999, "a b", "en", "s", 1), (99_998, "new text", "en", "s", 1)], SCHEMA)
    kept = {r.doc_id: (r.keep_id, r.kept) for r in exact_dedup.exact_duplicates(later, index).collect()}
    assert kept == {99_999: (10_004, False), 99_998: (99_998, True)}


def test_mixing(docs, empty):
    key = lambda r: tuple(round(x, 6) if isinstance(x, float) else x for x in r)
    got = mixing.mixture(docs.where("doc_id is not null")).collect()
    assert Counter(map(key, got)) == Counter(map(key, oracle(docs.where("doc_id is not null"), ORACLES["op9_mixing"])))
    assert all(r.taken <= 3 * r.size for r in got)
    assert mixing.mixture(empty).count() == 0
    assert mixing.apply_mix(docs).columns == docs.columns


def test_water_filling_clamps_and_reshares(spark):
    s = spark.createDataFrame([("a", 10, 5), ("b", 1000, 2), ("c", 990, 1)], "source string, source_size long, weight int")
    got = {r.source: r.target for r in mixing.water_fill(s).collect()}
    assert got == pytest.approx({"a": 30, "b": 1970 * 2 / 3, "c": 1970 / 3})


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(text):
    found = []
    for k, (kind, p) in enumerate(BASE.items()):
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m[0])
            total = sum((v := int(c) * (1 + i % 2)) - 9 * (v > 9) for i, c in enumerate(reversed(digits)))
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else 0, "card": 12 <= len(digits) <= 19 and total % 10 == 0, "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                found.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return found


def test_personal_data(docs, empty, spark):
    more = spark.createDataFrame([(20_000, "é x@y.z " * 700 + "1" * 3000, "en", "s", 1), (20_001, "joe [at] foo [dot] com tel (621) 555-4974", "en", "s", 1)], SCHEMA)
    rows = docs.unionByName(more).where("doc_id is not null").dropDuplicates(["doc_id"]).cache()
    texts = {r.doc_id: r.text or "" for r in rows.collect()}
    got = pii.digest_spans(pii.find_personal_data(rows)).collect()
    assert len(got) == len(texts)
    for r in got:
        spans = sorted(base_spans(texts[r.doc_id]))
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[1] == k for s in spans) for k in range(4)]
        assert r.base_sha256 == hashlib.sha256(",".join(s[2] for s in spans).encode()).hexdigest()
        assert {s[2] for s in spans} <= set(r.spans.split(",")) | {""}
    assert pii.digest_spans(pii.find_personal_data(empty)).count() == 0


def test_reliabilities_separate_good_and_bad_votes():
    p = pii.estimate_reliabilities({(0, (1, 1, 1, 1)): 90.0, (0, (-1, -1, 0, -1)): 60.0, (0, (1, -1, 1, 1)): 10.0})
    assert p[0, (1, 1, 1, 1)] > 0.9 > 0.1 > p[0, (-1, -1, 0, -1)]


def shingle_set(text):
    w = re.findall(r"\w+", (text or "").lower())
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


@pytest.mark.parametrize("block", [512, 16])
def test_ngram_join(spark, docs, empty, block):
    rng = random.Random(5)
    words = [f"w{rng.randint(0, 300)}" for _ in range(140)]
    near = [" ".join([*words[:i], f"z{i}", *words[i + 1 :]]) for i in range(60)]
    rows = docs.where("doc_id is not null").unionByName(spark.createDataFrame([(30_000 + i, t, "en", "s", 1) for i, t in enumerate(near + near[:5])], SCHEMA))
    data = [(r.doc_id, shingle_set(r.text)) for r in rows.collect()]
    links, parent = Counter(), list(range(len(data)))

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i, (_, a) in enumerate(data):
        for j in range(i):
            b = data[j][1]
            if a == b or len(a & b) >= 0.8 * len(a | b) - 1e-9:
                links[i] += 1
                links[j] += 1
                parent[max(root(i), root(j))] = min(root(i), root(j))
    classes = defaultdict(list)
    for i, (d, _) in enumerate(data):
        classes[root(i)].append(d)
    want = Counter((d, min(classes[root(i)]), len(classes[root(i)]), links[i]) for i, (d, _) in enumerate(data))
    got = Counter((r.doc_id, r.class_id, r.class_size, r.n_links) for r in ngram_join.similar_documents(rows, block=block).collect())
    assert got == want
    if block == 512:
        assert ngram_join.one_of_each_class(rows).count() == len(classes)
        assert ngram_join.similar_documents(empty).count() == 0


def test_links_when_blocks_get_no_node(spark, monkeypatch):
    rng = random.Random(8)
    texts = []
    for k in range(16):
        words = [f"k{k}w{rng.randint(0, 900)}" for _ in range(140)]
        texts += [" ".join(words), " ".join([*words, "end"])]
    rows = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], SCHEMA)
    for most in (200, 20):  # 2 and 14 blocks a pair of texts
        monkeypatch.setattr(ngram_join, "BLOCK_SHINGLES", most)
        assert {r.n_links for r in ngram_join.similar_documents(rows).collect()} == {1}


def test_one_of_each_class_whatever_the_ids(spark):
    text = lambda k: " ".join(f"k{k}w{i}" for i in range(40))
    near = text(3) + " end"
    data = [(None, text(0)), (None, text(1)), (None, text(1)), (7, text(2)), (7, text(3)), (8, near), (None, text(4)), (9, text(4)), (7, text(3)), (None, None), (None, "")]
    rows = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in data], SCHEMA)
    got = Counter((r.doc_id, r.text or "") for r in ngram_join.one_of_each_class(rows).collect())
    assert got == Counter([(None, text(0)), (None, text(1)), (7, text(2)), (7, text(3)), (9, text(4)), (None, "")])


def test_prefix_is_shortened_until_the_target():
    assert ngram_join.prefix_depth(0.8, 0.999) == 5
    assert ngram_join.prefix_depth(0.8, 0.99999) < 5
    assert ngram_join.prefix_depth(0.5, 0.9) < 5


@pytest.mark.parametrize("limit", [decontaminate.BROADCAST_HASHES, 0])
def test_decontamination(spark, empty, limit):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet").unionByName(spark.createDataFrame([(9_000, "a b"), (9_001, None)], "item_id long, text string"))
    want = set()
    listed = [(r.item_id, shingle_set(r.text)) for r in items.collect() if len(re.findall(r"\w+", r.text or "")) >= 5]
    for d in docs.collect():
        mine = shingle_set(d.text)
        want |= {(d.doc_id, i, len(s & mine), len(s)) for i, s in listed if len(s & mine) >= 0.8 * len(s) - 1e-9}
    assert {tuple(r)[:4] for r in decontaminate.contaminated(docs, items, broadcast_hashes=limit).collect()} == want
    clean = decontaminate.clean_documents(docs, items, broadcast_hashes=limit)
    assert clean.columns == docs.columns and clean.count() == docs.count() - len({w[0] for w in want})
    assert decontaminate.contaminated(empty, items, broadcast_hashes=limit).count() == 0


def test_sharding(docs, empty, spark):
    rows = docs.unionByName(spark.createDataFrame([(40_000 + i, "hot", "en", "s", 1) for i in range(60)], SCHEMA))
    got = sharding.shard_documents(rows).collect()
    n = Counter(r.shard for r in got)
    assert max(n.values()) - min(n.values()) <= 1 and len(got) == rows.count()
    for s in n:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(n[s]))
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((r.doc_id, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in rows.collect())
    hot = Counter(r.shard for r in got if r.text_crc32 == zlib.crc32(b"hot"))
    assert len(hot) <= -(-60 // min(n.values())) + 1
    assert sharding.shard_documents(empty).count() == 0


def test_toxicity_held_out(spark, empty):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = toxicity.score_documents(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.toxic for r in got) / len(got) > 0.97
    none = toxicity.score_documents(empty, labels)
    assert none.count() == 0


def test_toxicity_keeps_rare_words_of_large_vocabularies(spark):
    rng = random.Random(4)
    common = " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=14)) for _ in range(20_000))  # over 200,000 forms
    ids = [i for i in range(100) if zlib.crc32(str(i).encode()) % 5][:18]
    docs = spark.createDataFrame([(d, common + " zqxrare" * (i < 4)) for i, d in enumerate(ids)], "doc_id long, text string")
    labels = spark.createDataFrame([(d, int(i < 9)) for i, d in enumerate(ids)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert model.evidence("zqxrare") + model.drift > 0.5  # 4 of its 4 documents are toxic
    assert model.evidence("neverseen") + model.drift == 0


def test_maximal_segments_by_definition():
    rng = random.Random(2)
    for _ in range(200):
        x = [rng.choice([-2.0, -1.0, 1.0, 2.0, 3.0]) for _ in range(rng.randint(0, 12))]

        def parts(lo, hi):
            best = max(((sum(x[a:b]), -(b - a), -a, a, b) for a in range(lo, hi) for b in range(a + 1, hi + 1)), default=(0,))
            if best[0] <= 0:
                return []
            return [*parts(lo, best[3]), (best[3], best[4], best[0]), *parts(best[4], hi)]

        got = toxicity.maximal_segments(x)
        assert sum(s for *_, s in got) == pytest.approx(sum(s for *_, s in parts(0, len(x))))


PAGE = '<html><body><nav><a href=x>Home</a></nav><div class="ad">Buy</div><article><h1>T&amp;t</h1><p><b>One <i>two</i>&nbsp;three<br><p>Four\n five</article><div class="comments"><p>Reader says</p></div><footer>Foot</footer>'


def test_html(spark):
    assert html_extract.main_text(PAGE) == "T&t\nOne two three\nFour five"
    assert html_extract.main_text(None) == "" == html_extract.main_text("<p></p>")
    assert html_extract.main_text("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"
    pages = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (2, "v", "")], "page_id long, url string, html string")
    assert {(r.page_id, r.n_chars) for r in html_extract.extract(pages).collect()} == {(1, 27), (2, 0)}
    assert html_extract.extract(pages.limit(0)).count() == 0


def test_html_wrappers_with_furniture_names():
    body = "<p>One two three four five six.</p><p>Seven eight nine ten.</p>"
    want = "One two three four five six.\nSeven eight nine ten."
    foot = "<div class='comments'><p>Reader says</p></div><footer>Foot</footer>"
    assert html_extract.main_text(f"<body><div class='has-sidebar'><div class='row'><article>{body}</article></div></div>{foot}") == want
    assert html_extract.main_text(f"<body><div class='has-sidebar'><div class='row'>{body}</div></div><footer>Foot</footer>") == want
    assert html_extract.main_text(f"<body><form><div class='has-sidebar'>{body}</div></form>") == want
    assert html_extract.main_text(f"<body><nav><article>{body}</article></nav>") == ""
    # the set-aside div ends however much was left open inside it
    assert html_extract.main_text(f"<body><article><div class='comments'>x{'<b>' * 600}</div>{body}</article>") == want


def test_html_of_several_articles_and_of_none():
    text = "<p>" + "Some words of the text that goes on for a while here. " * 6 + "</p>"
    nav, link = "<nav><a href=x>Home</a></nav>", "<div><a href=x>Some link</a></div>"
    for page in (
        f"<main><article><h2>a</h2>{text * 2}</article><article><h2>b</h2>{text * 2}</article><article><h2>c</h2>{text * 3}</article></main>",
        f"<div><div><article>{text * 3}</article></div><div><article>{text * 3}</article><article>{text * 2}</article></div></div>",
        f"<article><p>Short one.</p></article><div>{text * 3}</div><div>{text * 3}</div><div>{text * 2}</div>",
        f"<div>{text * 3}</div><div>{text * 3}</div>",
    ):
        got = html_extract.main_text(f"<body>{nav}{page}{link}")
        assert got.count("Some words") == page.count("Some words") and "Some link" not in got


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "ngram_jaccard_join", "decontamination", "mixing", "token_ids"]
    out = corpus_pipeline.run(spark, SF)
    rows = out.collect()
    assert rows and {r.doc_id for r in rows} <= {r.doc_id for r in docs.collect()}
    assert sum(r.n_tokens for r in rows) == max(r.start + r.n_tokens for r in rows)
