"""Edge cases of every operator and stage in one matrix, and brute-force twins of what has no SQL."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")
from pyspark.sql import functions as F  # noqa: E402

from tidepool.llm import decontaminate, exact_dedup, html_extract, mixing, ngram_join, pii, sharding, token_counts, token_store, toxicity  # noqa: E402
from tidepool.llm.queries import tokenizer_file  # noqa: E402

SF = "/root/testdata/sf0.001"
#: Columns called like the operators' own helpers, and one that differs from ``text`` in case alone is none Spark could read.
CLASH = ["digest", "keep", "of", "leaked", "mix_copy", "mix_doc_id", "mix_tie", "__keep", "__n", "node", "score", "held_out", "shard", "c", "g", "bin", "text_sha256", "n_tokens"]


@pytest.fixture(scope="module")
def odd(spark):
    long = " ".join(f"w{i % 977}" for i in range(180_000))  # a million characters
    texts = [None, "", " \n\t ", long, long + " end", "same words here again and again", "same words here again and again", "SAME words here, again and again!", "x" * 300_000, "a\0b퟿c \U0001f600", "1.2.3.4 " * 3000, "zqx you utter fool"]
    data = [(i, t, "en", "s" if i % 3 else None) for i, t in enumerate(texts)]
    data += [(5, texts[5], "en", "s"), (5, texts[5], "en", "s"), (5, "other text under the same id", None, None), (None, "no id at all", "en", "s"), (None, None, None, None), (None, "no id at all", "en", "s")]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    for i, c in enumerate(CLASH):
        df = df.withColumn(c, F.lit(i) if i % 2 else F.lit(str(i)))
    return df.cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, int(i in (11, 8))) for i in range(12)] + [(11, 0, 0), (None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "same words here again and again"), (1, "same words here again and again"), (2, None), (3, ""), (None, "other text"), (4, "w1 w2 w3 w4 w5 w6 w7")], "item_id long, text string").withColumn("keep", F.lit(1))


OPERATORS = {
    "op1": lambda d, l, b: token_counts.count_tokens(d, tokenizer_file()),
    "op3": lambda d, l, b: toxicity.score_documents(d, l),
    "op4": lambda d, l, b: pii.digest_spans(pii.find_personal_data(d)),
    "op5": lambda d, l, b: exact_dedup.exact_duplicates(d),
    "op6": lambda d, l, b: token_store.token_ids(d, tokenizer_file()),
    "op7": lambda d, l, b: ngram_join.similar_documents(d),
    "op8": lambda d, l, b: sharding.shard_documents(d),
    "op9": lambda d, l, b: mixing.mixture(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_a_row_for_every_row(odd, labels, items, name):
    got = OPERATORS[name](odd, labels, items).collect()
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in odd.select("doc_id").collect())
    assert OPERATORS[name](odd.limit(0), labels.limit(0), items).count() == 0


STAGES = {
    "toxicity": lambda d, l, b: toxicity.without_toxic(d, l),
    "ngram_jaccard_join": lambda d, l, b: ngram_join.one_of_each_class(d),
    "decontamination": lambda d, l, b: decontaminate.clean_documents(d, b),
    "decontamination by shuffle": lambda d, l, b: decontaminate.clean_documents(d, b, broadcast_hashes=0),
    "mixing": lambda d, l, b: mixing.apply_mix(d),
}


@pytest.mark.parametrize("name", STAGES)
def test_stages_keep_columns_and_whole_rows(odd, labels, items, name):
    known = {tuple(r) for r in odd.collect()}
    out = STAGES[name](odd, labels, items)
    assert out.columns == odd.columns
    rows = [tuple(r) for r in out.collect()]
    assert rows and set(rows) <= known
    assert STAGES[name](odd.limit(0), labels, items.limit(0)).collect() == []
    texts = Counter(r[1] or "" for r in rows)
    if name == "ngram_jaccard_join":
        assert max(texts.values()) == 1 and sum("other text" in t for t in texts) == 1 and texts["no id at all"] == 1
    if name.startswith("decontamination"):
        whole = Counter(r.text or "" for r in odd.collect())
        gone = {t for t in whole if re.sub(r"\W+", " ", t.lower()).strip() == "same words here again and again" or t.startswith(("other text", "w0 w1 w2"))}
        assert texts == Counter({t: n for t, n in whole.items() if t not in gone})
        assert STAGES[name](odd, labels, items.limit(0)).count() == odd.count()


def test_toxicity_without_labels(odd, labels):
    assert {(r.score, r.predicted) for r in toxicity.score_documents(odd, labels.limit(0)).collect()} == {(0.0, 0)}
    assert toxicity.without_toxic(odd, labels.where("toxic = 0")).count() == odd.count()


# ---- brute force ----------------------------------------------------------------------------------


def maximal_by_definition(x):
    def parts(lo, hi):
        best = max(((sum(x[a:b]), -(b - a), -a, a, b) for a in range(lo, hi) for b in range(a + 1, hi + 1)), default=(0,))
        return [] if best[0] <= 1e-12 else [*parts(lo, best[3]), (best[3], best[4], best[0]), *parts(best[4], hi)]

    return parts(0, len(x))


def test_toxicity_scores_by_definition(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.fit(docs, labels)
    table = dict(zip(model.names.tolist(), model.values.tolist(), strict=True))
    from tidepool.llm.shingles import Spelled

    def name(letters, entire):
        s = Spelled([letters])
        n = s.name(np.array([0]), np.array([len(letters)]))
        return int((toxicity.whole(n) if entire else n)[0])

    def by_definition(text):
        seen, x = Counter(), []
        for w in re.findall(r"\w+", text.lower()):
            forms = [name(w, True), *(name(w[:n], False) for n in range(len(w), 2, -1))]
            e = next((table[f] for f in forms if f in table), 0.0) - model.drift
            if e > 0:
                seen[w] += 1
                e = (e + model.drift) / seen[w] - model.drift
            x.append(e)
        each = [-math.log(max(-math.expm1(-model.k * len(x) * math.exp(-model.lam * s)), 1e-300)) for _, _, s in maximal_by_definition(x)]
        strong = [e for e in each if e > -math.log(toxicity.SIGNIFICANT)]
        at = sum(w * v for w, v in zip(model.curve, (1, math.log1p(max(each, default=0)), math.log1p(sum(strong)), math.log1p(len(strong))), strict=True))
        return 1 / (1 + math.exp(-at))

    texts = [" ".join((r.text or "").split()[:40]) for r in docs.join(labels, "doc_id").orderBy(F.desc("toxic"), "doc_id").limit(40).collect()] + ["", "..."]
    assert model.score(texts).tolist() == pytest.approx([by_definition(t) for t in texts], abs=1e-9)


def test_maximal_segments_one_by_one():
    rng = random.Random(2)
    for _ in range(300):
        x = [rng.choice([-2.5, -1.25, 1.0, 2.0, 3.0]) + rng.random() / 1000 for _ in range(rng.randint(0, 14))]
        assert [(a, b) for a, b, _ in toxicity.maximal_segments(x)] == [(a, b) for a, b, _ in maximal_by_definition(x)]


def test_forest_ties_what_shares_a_prefix(spark, monkeypatch):
    rng = random.Random(6)
    width = ngram_join.LANE

    def label():  # few values a lane, so that prefixes of all lengths are shared
        out = 0
        for _ in range(ngram_join.DEPTH):
            out = (out << width) | rng.choice([1, 2, 500])
        return out

    nodes = [(i * 7919, [label() for _ in range(3)]) for i in range(300)]
    df = spark.createDataFrame(nodes, "node long, labels array<long>")
    ties = ngram_join.forest(df, 2, 6).collect()
    for depth in range(2, ngram_join.DEPTH + 1):
        parent = {n: n for n, _ in nodes}

        def root(a, parent=parent):
            while parent[a] != a:
                a = parent[a]
            return a

        for t in ties:
            if t.depth >= depth:
                parent[root(t.a)] = root(t.b)
        want = {n: n for n, _ in nodes}
        groups = defaultdict(list)
        for n, labels in nodes:
            for k, x in enumerate(labels):
                groups[k, x >> (width * (ngram_join.DEPTH - depth))].append(n)
        for g in groups.values():
            for n in g[1:]:
                want[root(n, want)] = root(g[0], want)
        same = lambda p: Counter(frozenset(x for x, _ in nodes if root(x, p) == r) for r in {root(x, p) for x, _ in nodes})  # noqa: B023, E731
        assert same(parent) == same(want)


def test_recall_of_the_join_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    sets = {}
    for r in docs.collect():
        w = re.findall(r"\w+", (r.text or "").lower())
        sets[r.doc_id] = frozenset(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, min(len(w), 1))))
    holders = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            holders[x].append(d)
    shared = Counter(p for h in holders.values() for i, a in enumerate(h) for p in ((a, b) for b in h[:i]))
    links = Counter()
    for (a, b), n in shared.items():
        if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n) - 1e-9:
            links[a] += 1
            links[b] += 1
    empty = [d for d, s in sets.items() if not s]
    links.update({d: len(empty) - 1 for d in empty if len(empty) > 1})
    got = {r.doc_id: r.n_links for r in ngram_join.similar_documents(docs).collect()}
    assert all(got[d] <= links[d] for d in got)
    assert sum(got.values()) >= 0.99 * sum(links.values()) > 0


def test_quotas_along_cycles():
    rng = np.random.default_rng(3)
    for _ in range(50):
        n = int(rng.integers(2, 7))
        wishes = rng.integers(0, 9, (n, n)) * (rng.random((n, n)) < 0.5)
        np.fill_diagonal(wishes, 0)
        free = rng.integers(0, 6, n) * (rng.random(n) < 0.4)
        may = sharding.admitted(wishes.copy(), free)
        assert (may >= 0).all() and (may <= wishes).all()
        assert (may.sum(axis=0) - may.sum(axis=1) <= free).all()
        left = wishes - may
        assert not (np.minimum(left, left.T) > 0).any()  # nobody could still trade
        room = free - may.sum(axis=0) + may.sum(axis=1)
        assert not (left[:, room > 0] > 0).any()


def test_shards_of_copies_only(spark):
    rng = random.Random(1)
    texts = [f"text {g}" for g in range(400) for _ in range(rng.choice([2, 2, 3, 5, 9]))] + ["giant"] * 300
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sharding.shard_documents(rows).collect()
    n = Counter(r.shard for r in got)
    assert len(n) == 24 and max(n.values()) - min(n.values()) <= 1
    spread = defaultdict(set)
    for r in got:
        spread[r.text_crc32].add(r.shard)
    assert sum(len(s) > 1 for s in spread.values()) < len(spread) / 3


def test_propagation_joins_members_within_room(spark):
    rng = random.Random(9)
    groups = [(g, m, None) for g in range(200) if (m := rng.randint(2, 12))]
    room = [sum(m for _, m, _ in groups) // 6 + 40] * 6
    first = sharding.first_labels(spark.createDataFrame([(g, m) for g, m, _ in groups], "g long, members long"), room)
    before = {r.g: r.c for r in first.collect()}
    after = {r.g: r.c for r in sharding.propagate(first, room).collect()}
    pairs = lambda state: sum(c * (c - 1) // 2 for x in state.values() for c in x)
    assert {g: sum(c) for g, c in after.items()} == {g: m for g, m, _ in groups} == {g: sum(c) for g, c in before.items()}
    assert pairs(after) > 3 * pairs(before)
    assert all(sum(c[s] for c in after.values()) <= max(room[s], sum(c[s] for c in before.values())) for s in range(6))
    tight = sharding.within_room(first, [x - 80 for x in room]).collect()
    assert all(sum(r.c[s] for r in tight) <= room[s] - 80 for s in range(6))


def test_short_items_word_for_word(spark):
    docs = spark.createDataFrame([(1, "well, to be or not it was"), (2, "to be, or what"), (3, "to be"), (4, None), (5, "To Be Or Not")], "doc_id long, text string")
    items = spark.createDataFrame([(10, "to be or not"), (11, "be or"), (12, " "), (13, "or not it was well")], "item_id long, text string")
    for limit in (decontaminate.BROADCAST_HASHES, 0):
        got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, items, broadcast_hashes=limit).collect()}
        assert got == {(1, 10), (5, 10), (1, 11), (2, 11), (5, 11)}


def test_size_classes_double():
    index = [type("R", (), {"item_id": i, "width": 5, "hashes": list(range(n)), "sketch": list(range(decontaminate.sketch_size(n)))}) for i, n in enumerate((1, 2, 3, 4, 7, 8, 100))]
    assert len(decontaminate.Searcher(index, 0.8).classes[5][1]) == 5
    for n in range(1, 300):
        k = decontaminate.sketch_size(n)
        assert k > n - math.ceil(0.8 * n - 1e-9)  # who holds a share of 0.8 misses fewer than k


def test_index_counts_later_copies(spark, tmp_path):
    rows = lambda *x: spark.createDataFrame(x, "doc_id long, text string")
    index = f"file://{tmp_path}/index"
    exact_dedup.exact_duplicates(rows((1, "a"), (2, "a"), (3, "b")), index).collect()
    spark.conf.set("spark.sql.shuffle.partitions", "5")  # the index keeps its own number of buckets
    try:
        got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_duplicates(rows((9, "a"), (8, "c"), (7, "c")), index).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert got == {9: (2, 3, False), 8: (8, 2, True), 7: (8, 2, False)}
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("digest_index")]


def test_added_spans(spark):
    key = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    texts = [f'here token = "{key[i:] + key[:i]}" and 4845168114407328 or 4111111111111111' for i in range(30)] + ["a" * 5000, "commit " + key, "mail me: joe [at] foo [dot] com"] * 2
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.digest_spans(pii.find_personal_data(df)).collect():
        t = texts[r.doc_id]
        secret = [f"secret:{m.start()}:{m.end()}" for m in re.finditer(r'(?<=")[0-9a-f]{40}', t)]
        card = [f"card:{m.start()}:{m.end()}" for m in re.finditer("4111111111111111", t)]
        if r.doc_id < 30:
            assert r.spans == ",".join(secret + card) and r.n_card == 1
        assert r.n_email == 0


def test_reliabilities_of_planted_votes():
    rng = random.Random(12)
    right = (0.95, 0.8, 0.7, 0.6)  # how often each labeler tells the truth
    counts = Counter()
    truth = defaultdict(Counter)
    for _ in range(20_000):
        y = rng.random() < 0.4
        votes = tuple(1 if (rng.random() < p) == y else -1 for p in right)
        counts[0, votes] += 1.0
        truth[0, votes][y] += 1
    posterior = pii.estimate_reliabilities(dict(counts))
    for k, n in counts.items():
        if n > 500:
            assert abs(posterior[k] - truth[k][True] / n) < 0.12


# ---- pages ----------------------------------------------------------------------------------------


def test_html_keeps_what_is_not_furniture():
    body = "<p>" + "Words of the text that goes on for a while here. " * 5 + "</p>"
    refs = "<ul><li><a href=a>Reference one of many</a></li><li><a href=b>Reference two of many</a></li><li><a href=c>Reference three</a></li></ul>"
    got = html_extract.main_text(f"<body><nav><a href=x>Home</a></nav><article>{body}<p id='notice-of-meeting'>The meeting is on.</p><div class='search-results'>{body}</div>{refs}<p><b>&am</b>p; &amp;</p></article><ul><li><a href=a>Out one</a><li><a href=b>Out two</a><li><a href=c>Out three</a></ul>")
    assert "The meeting is on." in got and got.count("Words of the text") == 10 and "Reference two" in got and "Out" not in got and "Home" not in got
    assert got.endswith("&amp; &")
    assert all(map(html_extract._names_furniture, ["ad", "ad-slot-3", "siteFooter", "cookie-banner", "post-comments", "related-posts", "sidebar", "left-sidebar", "share-buttons", "search"]))
    assert not any(map(html_extract._names_furniture, ["has-sidebar", "search-results", "notice-of-meeting", "related-work", "content", "article-body", "no-ads"]))


def test_html_density_by_definition():
    rng = random.Random(5)
    for _ in range(30):
        source = "<body>" + "".join(rng.choice(["<div>", "</div>", "<p>", "</p>", "<a href=x>", "</a>", "some words here ", "x ", "<br>", "<span>", "</span>"]) for _ in range(60))
        page = html_extract.Page(source)
        n = len(page.tag)

        def above(i, page=page):
            while i >= 0:
                yield i
                i = page.parent[i]

        size = lambda t: len(t.replace(" ", "").replace("\n", ""))
        for i in range(n):
            held = [(x, t) for x, t in page.runs if t is not None and i in above(x)]
            chars, links = sum(size(t) for _, t in held), sum(size(t) for x, t in held if any(page.tag[u] == "a" for u in above(x)))
            assert (page.chars[i], page.link_chars[i]) == (chars, links)
            inside = [j for j in range(1, n) if j != i and i in above(j)]
            tags, link_tags = max(len(inside), 1), sum(page.tag[j] == "a" for j in inside)
            children = [j for j in range(1, n) if page.parent[j] == i]
            whole = sum(size(t) for _, t in page.runs if t is not None)
            if chars:
                base = math.log(chars / max(chars - links, 1) * links + page.link_chars[page.body] / max(page.chars[page.body], 1) * chars + math.e)
                want = chars / tags * (math.log(chars / max(links, 1) * tags / max(link_tags, 1) + 1e-9) / math.log(base + 1e-9) if base > 1.0000001 else math.log(chars * tags + 1))
                assert page.density[i] == pytest.approx(want) and chars <= whole
            total = sum(page.density[j] for j in children)
            assert page.sums[i] == pytest.approx(total if total else page.density[i])


def test_densities_choose_where_no_name_does(spark):
    """Pages stripped of every telling tag and name: densities alone find nearly all articles, and scrambled ones don't."""
    plain, found, scrambled = 0, 0, 0
    measure = html_extract.Page._measure

    def noise(self):
        measure(self)
        rng = random.Random(1)
        self.density, self.sums = [rng.random() * 100 for _ in self.tag], [rng.random() * 100 for _ in self.tag]

    for (source,) in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect():
        want = html_extract.main_text(source)
        bare = re.sub(r"<(/?)(article|footer)\b", r"<\1div", source).replace('class="ad"', 'class="zz"')
        plain += 1
        found += html_extract.main_text(bare) == want
        html_extract.Page._measure = noise
        try:
            scrambled += html_extract.main_text(bare) == want
        finally:
            html_extract.Page._measure = measure
    assert found > 0.9 * plain and scrambled < 0.2 * plain


def test_very_long_page(spark):
    page = "<body><nav>x</nav><article>" + "<p>Some words of a paragraph.</p>" * 40_000 + "</article>"
    text = html_extract.main_text(page)
    assert text.count("\n") == 39_999


# ---- pipeline -------------------------------------------------------------------------------------


def test_pipeline_equals_its_stages_by_brute_force(spark):
    import corpus_pipeline

    out = {r.doc_id: r.n_tokens for r in corpus_pipeline.run(spark, SF).collect()}
    docs, labels, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    toxic = {r.doc_id for r in toxicity.score_documents(docs, labels).collect() if r.predicted}

    def shingle_set(text):
        w = re.findall(r"\w+", (text or "").lower())
        return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])

    left = [(r.doc_id, shingle_set(r.text)) for r in docs.orderBy("doc_id").collect() if r.doc_id not in toxic]
    parent = list(range(len(left)))

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i, (_, a) in enumerate(left):
        for j in range(i):
            if a == left[j][1] or len(a & left[j][1]) >= 0.8 * len(a | left[j][1]) - 1e-9:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    kept = [x for i, x in enumerate(left) if root(i) == i]
    wanted = [shingle_set(r.text) for r in items.collect()]
    clean = {d for d, s in kept if not any(len(s & w) >= 0.8 * len(w) - 1e-9 for w in wanted)}
    mixed = {r.doc_id: r.taken for r in mixing.mixture(docs.where(F.col("doc_id").isin(sorted(clean)))).collect()}
    assert set(out) == {d for d, taken in mixed.items() if taken or d in out} <= clean
