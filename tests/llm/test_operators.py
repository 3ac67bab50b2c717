"""Small cases of the numbered operators, against plain versions of themselves."""

import hashlib
import random
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from evalmill.llm import chat, decontaminate, html_consensus, labelled, lattice, minhash, mixing, planes, quality, queries, toxicity, wordpiece

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
ENCODER = planes.WordEncoder(WORD_BPE, limit=100)
DOC = "doc_id long, text string, lang string, source string, n_chars long, key string, id long, n long"
ODD_TEXTS = [None, "", "  \n ", "one", "one", "x" * 50_000, "two words", "two words"]


def documents(spark, texts, ids=None):
    """Documents with columns whose names the operators use inside."""
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", f"src{k % 3}", len(t or ""), "k", 7, 7) for k, (i, t) in enumerate(zip(ids, texts))], DOC)


def components(n, linked):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(n):
        for b in range(a):
            if linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [find(x) for x in range(n)]


def test_near_duplicates_match_all_pairs(spark):
    rng = random.Random(3)
    texts = list(ODD_TEXTS)
    for _ in range(6):
        base = [f"w{rng.randrange(500)}" for _ in range(rng.choice([12, 60, 200]))]
        for edits in (0, 0, 1, 2, 4, 9, 20):
            copy = list(base)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = f"e{rng.randrange(500)}"
            texts.append(" ".join(copy))
    got = {r.doc_id: r for r in minhash.near_duplicates(documents(spark, texts), n=2).collect()}
    sets = [minhash.shingle_set(t, 2) for t in texts]
    want = components(len(texts), lambda a, b: bool(sets[a] & sets[b]) and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]))
    assert [got[i].component_id for i in range(len(texts))] == want
    assert [got[i].n_shingles for i in range(len(texts))] == [len(s) for s in sets]
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def test_near_duplicates_of_empty_table_and_odd_ids(spark):
    assert minhash.near_duplicates(documents(spark, [])).count() == 0
    rows = minhash.near_duplicates(documents(spark, ["a b c d e f"] * 3, [None, 4, 4])).collect()
    assert sorted((r.doc_id or -1, r.component_id, r.kept) for r in rows if r.doc_id) == [(4, 4, True)] * 2
    assert [(r.component_id, r.kept) for r in rows if r.doc_id is None] == [(None, True)]
    a, b = "a b c d e f g h", "n o p q r s t u"
    rows = minhash.near_duplicates(documents(spark, [a, a, b, b, ""], [1, 5, 5, 9, 5])).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in rows) == [(1, 4, 1), (5, 0, 5), (5, 4, 1), (5, 4, 1), (9, 4, 1)]


def test_rare_prefixes_keep_every_linked_pair(spark):
    rng = random.Random(9)
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join(w if rng.random() > rate else f"e{rng.randrange(30)}" for w in base) for rate in (0, 0.02, 0.04, 0.07, 0.1, 0.2) for _ in range(8)]
    texts += ["a", "a b", "a b c"]
    sets = {minhash.xxhash.xxh128_digest(h.tobytes()): h for h in (minhash.shingle_hashes(t, 2, minhash.WordHashes()) for t in texts)}
    rare = minhash._rare_prefixes(spark.createDataFrame([(t,) for t in texts], "text string"), 2, 80).collect()
    assert {bytes(r.fp) for r in rare} == set(sets)
    rows = spark.createDataFrame([(i, len(sets[bytes(r.fp)]), r.rare) for i, r in enumerate(rare)], "id long, n long, rare array<long>")
    a, b = (rows.select(*(rows[c].alias(s + c) for c in rows.columns)) for s in "ab")
    kept = {(r.aid, r.bid) for r in a.join(b, a.aid < b.bid).where(minhash._share_rare("a", "b", 80)).collect()}
    plain = [set(sets[bytes(r.fp)].tolist()) for r in rare]
    linked = {(i, j) for j in range(len(rare)) for i in range(j) if 100 * len(plain[i] & plain[j]) >= 80 * len(plain[i] | plain[j])}
    assert linked and linked <= kept and len(kept) < len(rare) * (len(rare) - 1) // 2


def test_chunks_find_all_pairs_within_the_radius():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a = rng.integers(0, 1 << 16, minhash.CHUNKS * minhash.WIDTH)
        b = a.copy()
        at = rng.choice(len(a), minhash.RADIUS, replace=False)
        b[at] ^= 1
        errors = (a != b).reshape(minhash.CHUNKS, minhash.WIDTH).sum(axis=1)
        assert errors.min() <= minhash.RADIUS // minhash.CHUNKS


@given(st.sets(st.text("abc", min_size=1, max_size=4), max_size=9), st.sets(st.text("abc", min_size=1, max_size=4), max_size=9), st.text("abc", max_size=10))
@settings(max_examples=300, deadline=None)
def test_longest_match_counts(first, inner, word):
    pieces = first | {"##" + p for p in inner}
    at = n = 0
    while at < len(word):
        ends = [e for e in range(len(word), at, -1) if ("##" if at else "") + word[at:e] in pieces]
        if not ends:
            n = 0
            break
        at, n = ends[0], n + 1
    assert wordpiece.LongestMatch(sorted(pieces), "##").count(word) == n


def test_token_counts_of_odd_texts(spark):
    rows = {r.doc_id: r for r in wordpiece.token_counts(documents(spark, ODD_TEXTS), WORD_BPE, prefix="", end="</w>").collect()}
    assert [rows[i].n_words for i in range(len(ODD_TEXTS))] == [0, 0, 0, 1, 1, 1, 2, 2]
    assert rows[0].n_tokens == 0 and rows[3].n_tokens == 1 and rows[5].n_tokens > 1000


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script></head><body class="has-sidebar"><nav>menu</nav>
<div class="ad">buy</div><div class="post-{i}"><h1>A &amp; B {i}</h1><p>Some   text, <b>bold<br><p>and more&nbsp;of it.<form>f</form><ul><li>x<li>y</ul></div>
<section id="comments"><p>{c}</p></section><aside>s</aside><footer>&copy;</footer></body></html>"""


def test_main_texts(spark):
    rows = [(i, f"http://h{i % 2}.example.com/{i}", PAGE.replace("{i}", str(i)).replace("{c}", "long comment " * 40), "x") for i in range(6)]
    rows += [(6, None, None, "x"), (7, "odd", "", "x"), (7, "odd", "plain text", "x")]
    got = html_consensus.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string, host string")).collect()
    text = {r.page_id: r.text for r in got if r.page_id < 7}
    assert all(text[i] == f"A & B {i}\nSome text, bold\nand more of it.\nx\ny" for i in range(6)) and text[6] == ""
    assert sorted(r.text for r in got if r.page_id == 7) == ["", "plain text"]
    assert all(r.n_chars == len(r.text) for r in got)
    assert html_consensus.main_texts(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_rare_templates_keep_their_own_article(spark):
    box, story = "<div class='x'><p>%s</p></div>" % ("unmarked box " * 8), "<p>%s</p>" % ("running text of the story " * 30)
    page = lambda i: f"<body>{box}<article>{story}</article></body>" if i >= 5 else f"<body>{box}<div class='t{'ab'[i % 2]}'>{story}</div></body>"
    rows = [(i, f"http://h.example.com/{i}", page(i)) for i in range(100)]
    got = html_consensus.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == 100 and {r.text for r in got} == {("running text of the story " * 30).strip()}
    kinds = html_consensus.consensus_paths(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((r.path == r.paths[0], r.votes) for r in kinds) == [(True, 2), (True, 3), (True, 95)]


def test_pages_of_a_host_vote_for_the_path_below_the_best(spark):
    story, box = "<p>%s</p>" % ("running text of the story " * 30), "<p>%s</p>" % ("a box that is no story " * 6)
    usual = f"<body><article><div class='s1'>{story}</div></article></body>"
    odd = f"<body><article><div class='s2'>{story}</div>{box}</article></body>"
    rows = [(i, "http://h.example.com/", odd if i == 7 else usual) for i in range(8)] + [(8, "http://other.example.com/", odd)]
    got = {r.page_id: r.text for r in html_consensus.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    story, box = ("running text of the story " * 30).strip(), ("a box that is no story " * 6).strip()
    assert all(got[i] == story for i in range(7)) and got[7] in (story, f"{story}\n{box}") and got[8] == f"{story}\n{box}"


@pytest.mark.parametrize(
    "html, text",
    [
        ("<p>Intro</p><svg/><p>Second</p>", "Intro\nSecond"),
        ("<p>a<svg><svg>in</svg>out</svg><p>b", "a\nb"),
        ("<p>a</p><svg><g><p>b</p></g></svg>", "a\nb"),
        ("<p>a</p><object><p>b</p><template><p>c</p><noscript><p>d</p>", "a\nb\nc\nd"),
        ("<p>a</p><object>x</object><noscript>y</noscript><template>z</template><p>b</p>", "a\nb"),
        ("<p>a</p><div class=\"x>b<p>c", "a\nb\nc"),
        ("<p title=\"1 > 0\" class='q'>a</p>", "a"),
        ("<p>x <math><mi>y</mi></math> z</p>", "x y z"),
        ("<p>a<script>x<y</p></script>b<style>unclosed", "ab"),
        ("a < b <3 c<p>d <div class=", "a < b <3 c\nd"),
        ("<p>a<!-->b<!-- c -->d<!-- e", "abd"),
        ("", ""),
    ],
)
def test_odd_markup(html, text):
    assert html_consensus.text_below(html, None) == text


def test_deep_and_broken_pages_take_linear_time():
    for html in ("<div class=abc>x" * 50_000, '<div class="x>' * 50_000, "<b>" * 30_000 + "<h1>x</h1>" * 30_000, "<svg>" * 50_000, "<p a='" * 50_000, "<!--" * 50_000, "<p " + "a'b\"" * 50_000 + "x"):
        began = time.process_time()
        html_consensus.text_below(html, None)
        assert time.process_time() - began < 6


def plain_page(tree, depth=0):
    """(html, blocks) of nested [tag, class, children], where children are texts or elements; what is dropped has no blocks."""
    tag, cls, children = tree
    inner = [plain_page(c) if isinstance(c, list) else (c, [c] if c.strip() else []) for c in children]
    html = f"<{tag} class='{cls}'>" + "".join(h for h, _ in inner) + f"</{tag}>"
    dropped = tag in ("nav", "aside", "svg", "noscript") or cls in ("sidebar", "ad")
    return html, [] if dropped else [b for _, bs in inner for b in bs]


TREES = st.recursive(
    st.text("abc ", min_size=1, max_size=12).map(lambda t: ["p", "t", [t]]),
    lambda inner: st.tuples(st.sampled_from(["div", "section", "nav", "aside", "ul", "blockquote"]), st.sampled_from(["x", "story", "sidebar", "ad"]), st.lists(inner, max_size=4)).map(list),
    max_leaves=12,
)


@given(TREES)
@settings(max_examples=200, deadline=None)
def test_pages_read_as_plain_trees(tree):
    html, blocks = plain_page(tree)
    nodes, got = html_consensus.read_page(html)
    assert [text for _, text in got] == [" ".join(b.split()) for b in blocks]
    path = html_consensus.candidate_paths(nodes)[0]
    assert html_consensus.text_below(html, nodes[0].path) == "\n".join(text for _, text in got) and isinstance(path, int)


def test_contamination_matches_full_search(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    items = [(i, " ".join(word() for _ in range(20)) + ". " + " ".join(word() for _ in range(9)) + ".") for i in range(40)]
    items += [(50, None), (51, "one"), (52, "")]
    texts = [" ".join(word() for _ in range(120)) for _ in range(30)]
    for k in range(10):
        texts[k] = texts[k] + " " + items[k][1] + " " + texts[k]
    texts += [None, "", "word", items[11][1][: len(items[11][1]) // 4]]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = documents(spark, texts)
    got = decontaminate.contamination(docs, bench)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == {(k, k) for k in range(10)}
    kept = decontaminate.drop_contaminated(docs, bench)
    assert {r.doc_id for r in kept.collect()} == set(range(10, len(texts))) and kept.columns == docs.columns
    assert decontaminate.contamination(docs, bench.limit(0)).count() == 0


def test_other_items_never_change_a_hit(spark):
    rng = random.Random(15)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    question, answer = " ".join(word() for _ in range(20)) + ".", " ".join(word() for _ in range(9)) + "."
    near, far = " ".join(word() for _ in range(20)), " ".join(word() for _ in range(150))
    docs = documents(spark, [f"{question} {near} {answer}", f"{question} {far} {answer}"])
    long_item = " ".join(word() for _ in range(405))
    found = []
    for items in ([(1, f"{question} {answer}")], [(1, f"{question} {answer}"), (2, long_item)]):
        got = decontaminate.contamination(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
        found.append({(r.doc_id, r.item_id) for r in got})
    assert found[0] == found[1] == {(0, 1)}
    assert [decontaminate.length_class(n) for n in (0, 1, 64, 65, 128, 405)] == [64, 64, 64, 128, 128, 512]


def test_block_max_search_is_exact():
    rng = random.Random(8)
    words = [f"t{i}" for i in range(30)]
    items = {i: " ".join(rng.choices(words, k=12)) for i in range(120)}
    weights = {}
    for i, text in items.items():
        w = text.split()
        for pair in set(zip(w, w[1:])):
            weights[i, pair] = rng.random()
    index = decontaminate.BlockMaxIndex([(i, a, b, v) for (i, (a, b)), v in weights.items()], items)
    for threshold in (0.2, 0.6, 1.5):
        for _ in range(60):
            query = rng.choices(words, k=40)
            _, term = index.terms(query)
            pairs = set(zip(query, query[1:]))
            want = {i: sum(weights.get((i, p), 0) for p in pairs) for i in items}
            got = dict(index.search(np.unique(term).tolist(), threshold))
            assert {index.ids[n] for n in got} == {i for i, s in want.items() if s >= threshold}


def test_near_vectors_match_all_pairs(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(40, 32))
    rows = [b + rng.normal(size=32) * s for b in base for s in (0, 0.05, 0.2, 0.3)] + [base[0], base[0]]
    labels = [i % 3 for i in range(40) for _ in range(4)] + [0, 1]
    data = [(i, [float(x) for x in v], lab) for i, (v, lab) in enumerate(zip(rows, labels))]
    odd = [None, [], [0.0] * 32, [float("nan")] * 32, [None] + [1.0] * 31]
    data += [(len(data) + k, v, 0) for k, v in enumerate(odd)] + [(len(data) + 5, data[0][1], None)]
    got = {r.vec_id: r for r in lattice.near_vectors(spark.createDataFrame(data, "vec_id long, embedding array<double>, label int")).collect()}
    unit = np.array([r / np.linalg.norm(r) for r in rows])
    cos, same = unit @ unit.T, np.equal.outer(np.array(labels), np.array(labels))
    linked = (cos >= 0.93) & same & ~np.eye(len(rows), dtype=bool)
    found = sum(got[i].n_links for i in range(len(rows)))
    assert 0.9 * linked.sum() <= found <= linked.sum() and all(got[i].n_links <= linked[i].sum() for i in range(len(rows)))
    assert all(got[i].n_links == 0 and got[i].component_id == i for i in range(len(rows), len(data)))
    assert lattice.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_lattice_points_are_nearest():
    rng = np.random.default_rng(0)
    near = np.concatenate([lattice.minimal_vectors(), np.zeros((1, 8))])
    assert len(near) == 241 and np.allclose((near[:-1] ** 2).sum(axis=1), 2)
    x = rng.normal(size=(500, 8)) * 2
    p = lattice.nearest_e8(x)
    assert (((x - p) ** 2).sum(axis=1)[:, None] <= ((x[:, None] - p[:, None] - near) ** 2).sum(axis=2) + 1e-9).all()


def test_mixing_meets_its_limit_and_loses_nothing(spark):
    texts = ["a b c d"] * 60 + ["a b c d"] * 20 + [None, ""]
    sources = ["big"] * 60 + ["small"] * 20 + ["big", None]
    df = spark.createDataFrame([(i, t, s, "b", 1) for i, (t, s) in enumerate(zip(texts, sources))], "doc_id long, text string, source string, block string, epoch int")
    rows = mixing.mixed(df, max_repeats=2.0, block_tokens=16).collect()
    assert {r.doc_id for r in rows} == set(range(82))
    count = lambda s: sum(r.source == s and r.text == "a b c d" for r in rows)
    assert count("big") == 60 and 36 <= count("small") <= 40
    assert mixing.mixed(df.limit(0)).count() == 0
    shares = spark.createDataFrame([("a", 70, 0.7), ("b", 20, 0.2), ("c", 10, 0.1)], "source string, tokens long, share double")
    p = np.array([0.7, 0.2, 0.1])
    w = p ** mixing.find_exponent(shares, target_entropy=1.0)
    w /= w.sum()
    assert abs(-(w * np.log(w)).sum() - 1.0) < 1e-5
    assert abs(mixing.find_exponent(shares, max_repeats=2.0) - (1 - np.log(2) / np.log(7))) < 1e-6
    e = mixing.find_exponent(shares, max_repeats=2.0, budget_tokens=150)
    assert 0 < e < 1 and abs((p ** (e - 1) / (p**e).sum()).max() * 1.5 - 2) < 1e-4
    assert mixing.find_exponent(shares) == 0.0 and mixing.find_exponent(shares.limit(0), max_repeats=2.0) == 0.0


@pytest.mark.parametrize("budget", [None, 90, 700, 5000])
def test_mixing_takes_what_plain_blocks_take(spark, budget):
    rng = random.Random(budget or 1)
    rows = [(i % 150, " ".join("w" for _ in range(rng.randrange(12))), rng.choice(["a", "a", "a", "b", None])) for i in range(160)] + [(7, None, "a"), (None, "x y", "b")]
    df = spark.createDataFrame([(*r, "o", "o", "o", "o", "o") for r in rows], "doc_id long, text string, source string, size string, room string, s string, _place string, Epoch string")
    got = mixing.mixed(df, max_repeats=2.0, budget_tokens=budget, block_tokens=16, seed=3)
    assert got.columns == [*df.columns, "mix_epoch", "block", "weight"]
    h = mixing.F.xxhash64(mixing.F.lit(3), "doc_id", "text")
    hashed = [(r.doc_id, r.text, r.source, r.h) for r in df.withColumn("h", h).collect()]
    size = lambda t: len((t or "").split())
    total = Counter()
    for _, t, s, _ in hashed:
        total[s] += size(t)
    everything = sum(total.values())
    share = {s: n / everything for s, n in total.items()}
    low, high = 0.0, 1.0
    def repeats(e):
        z = sum(p**e for p in share.values())
        take = max(p ** (1 - e) for p in share.values()) * z if budget is None else min(budget / everything, 2.0)
        return max(p ** (e - 1) for p in share.values()) / z * take
    if repeats(0.0) > 2:
        for _ in range(32):
            low, high = (low, (low + high) / 2) if repeats((low + high) / 2) <= 2 else ((low + high) / 2, high)
        low = high
    z = sum(p**low for p in share.values())
    want = Counter()
    for s, n in total.items():
        weight = share[s] ** low / z
        take = max(p ** (1 - low) for p in share.values()) * z * everything if budget is None else min(budget, 2 * everything)
        goal = int(weight * take + 1e-6)
        goal = max(goal, n) if budget is None else goal
        whole, part = divmod(goal, n)
        mine = [r for r in hashed if r[2] == s and size(r[1])]
        blocks = -(-n // 16)
        values = spark.createDataFrame([(r[3], r[3] % blocks) for r in mine], "h long, b long").select("h", "b", mixing.block_value(mixing.F.col("b"), mixing.F.lit(whole).cast("long"), 3).alias("v"), mixing.place_value(mixing.F.col("h"), mixing.F.lit(whole).cast("long"), 3).alias("p")).collect()
        order = {r.h: (r.v, r.b, r.p) for r in values}
        want.update({(r[0], r[1], s, e): c for r, c in Counter((r[0], r[1]) for r in mine).items() for r in [r] for e in range(whole)})
        left = part
        for block in sorted({order[r[3]][:2] for r in mine}):
            inside = [r for r in mine if order[r[3]][:2] == block]
            if sum(size(r[1]) for r in inside) <= left:
                want.update((r[0], r[1], s, whole) for r in inside)
                left -= sum(size(r[1]) for r in inside)
                continue
            for place in sorted({order[r[3]][2] for r in inside}):
                same = [r for r in inside if order[r[3]][2] == place]
                if sum(size(r[1]) for r in same) > left:
                    break
                want.update((r[0], r[1], s, whole) for r in same)
                left -= sum(size(r[1]) for r in same)
            break
    want.update((r[0], r[1], r[2], 0) for r in hashed if not size(r[1]))
    assert Counter((r.doc_id, r.text, r.source, r.mix_epoch) for r in got.collect()) == want


def test_quality_and_toxicity_learn_and_score_everything(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choices(["an", "ti", "re", "on", "es", "the"], k=rng.randint(1, 3)))
    clean = lambda: [word() for _ in range(rng.randint(10, 80))]
    texts, labels = [], []
    for i in range(240):
        words, q, t = clean(), int(i % 3 != 0), int(i % 2)
        if t:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["gronk", "blargon", "zzurt"]))
        texts.append(" ".join(words) if q else " ".join(w.upper() + "!!" for w in words))
        labels.append((i, q, t))
    docs = documents(spark, texts + [None, ""])
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    held = labelled.held_out("doc_id", 3, 1)
    test = [i for i in range(240) if zlib.crc32(str(i).encode()) % 3 == 1]
    model = quality.fit_quality(docs, known, ~held)
    scores = {r.doc_id: r.score for r in quality.quality_scores(docs, model).collect()}
    assert len(scores) == 242 and np.mean([(scores[i] >= 0.5) == labels[i][1] for i in test]) > 0.9
    assert quality.keep_good(docs, model).columns == docs.columns
    toxic = toxicity.fit_toxicity(docs, known, ~held)
    scores = {r.doc_id: r.score for r in toxicity.toxicity_scores(docs, toxic).collect()}
    assert len(scores) == 242 and np.mean([(scores[i] >= 0.3) == labels[i][2] for i in test]) > 0.9
    tail = ["clean words here " * 1500 + "GRONK!! " * 40] * 3
    blocks = quality.fit_quality(documents(spark, tail + ["plain text of the good kind " * 800] * 3), spark.createDataFrame([(i, int(i > 2), 0) for i in range(6)], "doc_id long, quality int, toxic int"))
    assert blocks.good and blocks.bad
    for fit, score, name in ((quality.fit_quality, quality.quality_scores, "quality"), (toxicity.fit_toxicity, toxicity.toxicity_scores, "toxic")):
        assert score(docs.limit(0), fit(docs.limit(0), known)).count() == 0, name
    none = quality.fit_quality(docs, known.limit(0))
    assert {r.score for r in quality.quality_scores(docs, none).collect()} == {0.5}


def test_every_word_of_a_text_is_learnt_from():
    texts = [" ".join(f"w{i}" for i in range(9000)), "short text", ""]
    trainer = toxicity.Trainer(texts, [1, 0, 0])
    assert len(trainer.words) == 9002 and set(trainer.at[trainer.owner == 0].ravel().tolist()) >= set(range(9000))
    assert np.bincount(trainer.owner).tolist() == [len(toxicity.windows(n)) for n in (9000, 2, 0)]


def test_worst_window_is_that_of_a_plain_loop():
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["ab", "cd", "efg", "hij"]) for _ in range(n)) for n in (0, 1, 23, 24, 25, 42, 43, 100)]
    net = toxicity.Network.fresh(toxicity.Vocabulary([b"ab", b"efg"], np.arange(1, toxicity.GRAM_SPACE, 7)))
    got = toxicity.Scorer(net).worst(texts)
    for text, score in zip(texts, got):
        words = toxicity.words_of(text)
        logits = []
        for start in range(0, max(1, len(words) - toxicity.WINDOW + toxicity.STRIDE), toxicity.STRIDE):
            part = words[start : start + toxicity.WINDOW] or [b"ab"]
            logits.append(net.logits(net.gates(net.vectors(part))[:, None, :], np.full((len(part), 1), float(bool(words)), np.float32))[0])
        assert abs(max(logits) - score) < 1e-4


def test_toxic_words_inside_long_runs_show():
    rng = random.Random(6)
    word = lambda: "".join(rng.choices(["an", "ti", "re", "on", "es", "the"], k=rng.randint(1, 3)))
    bad = ["gronk", "blargon", "zzurt"]
    texts = [[word() for _ in range(rng.randint(10, 80))] for _ in range(240)]
    for t in texts[::2]:
        for _ in range(3):
            t.insert(rng.randrange(len(t)), rng.choice(bad))
    scorer = toxicity.Scorer(toxicity.Trainer([" ".join(t) for t in texts], [int(i % 2 == 0) for i in range(240)]).fit())
    half = [word() for _ in range(1200)]
    for joint in ("\u00a0", "\u3000", "_", "...", ",", "\u3002", ""):
        clean, toxic = joint.join(half + half), joint.join(half + bad + half)
        assert len(clean.encode()) > 10_000
        low, high = scorer.worst([clean, toxic])
        assert high > 0 > low, joint


@given(st.text("aé_-.\u00a0x漢", min_size=30, max_size=200))
@settings(max_examples=300, deadline=None)
def test_words_of_long_runs_hold_every_gram(text):
    words = toxicity.words_of(text)
    assert all(0 < len(w) <= toxicity.LONGEST for w in words)
    grams = lambda w: {w[i : i + n] for n in toxicity.GRAMS for i in range(len(w) - n + 1)} | set(w)
    got = set().union(*map(grams, words))
    for run in text.lower().split():
        assert grams(run.encode()) <= got


def test_network_gradients():
    net = toxicity.Network.fresh(toxicity.Vocabulary([b"a"], np.array([3])))
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(0)
    x, mask = rng.normal(size=(5, 3, 2 * toxicity.DIM)), np.ones((5, 3))
    mask[3:, 1] = 0
    y, weight = np.array([0.0, 1.0, 1.0]), np.ones(3)

    def loss():
        s = net.logits(np.concatenate([x @ net.p["Wf"] + net.p["cf"], x @ net.p["Wb"] + net.p["cb"]], axis=2), mask)
        return float((np.logaddexp(0, s) - y * s).sum())

    grads, dx = net.gradients(x, mask, y, weight)
    for name, g in grads.items():
        at = tuple(rng.integers(0, n) for n in g.shape)
        was, e = net.p[name][at], 1e-3
        net.p[name][at] = was + e
        up = loss()
        net.p[name][at] = was - e
        down = loss()
        net.p[name][at] = was
        assert abs((up - down) / (2 * e) - g[at]) < 2e-2 * max(1, abs(g[at])), name


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "", "tool<s>"]), st.text("a\\<>/s[]INST|é ", max_size=30)), max_size=6))
@settings(max_examples=300, deadline=None)
def test_template_round_trip(turns):
    text, spans = chat.format_turns(turns)
    assert chat.parse_turns(text) == turns
    assert "".join(chat.unescape(text[s:e]) for s, e in spans) == "".join(t for r, t in turns if r == "assistant")


def test_reply_trees(spark):
    rows = [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "bad", 0.1), (1, 3, 1, "assistant", "good", 0.9), (1, 4, 3, "user", "more", 0.9), (1, 5, 4, "assistant", "end", 0.9), (2, 1, 9, "user", None, None), (3, 1, 2, "user", "x", 1.0), (3, 2, 1, "user", "y", 1.0)]
    m = spark.createDataFrame(rows, "tree long, id long, parent long, role string, text string, score double").fillna("", "text")
    got = {(r.tree, r.rank): r for r in chat.format_trees(m, branches=2).collect()}
    assert [t for _, t in chat.parse_turns(got[1, 1].formatted)] == ["q", "good", "more", "end"]
    assert [t for _, t in chat.parse_turns(got[1, 2].formatted)] == ["q", "bad"]
    assert set(got) == {(1, 1), (1, 2), (2, 1)}
    again = {(r.tree, r.rank): r.formatted for r in chat.format_trees(m.union(m).union(m), branches=2).collect()}
    assert again == {k: r.formatted for k, r in got.items()}


def test_conversations_with_odd_rows(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, None, None), (None, 5, "assistant", "b")]
    m = chat.linear_messages(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r.tree: chat.parse_turns(r.formatted) for r in chat.format_trees(m).collect()}
    assert got == {1: [("", ""), ("user", "a"), ("user", "a")], None: [("assistant", "b")]}
    assert chat.format_trees(m.limit(0)).count() == 0


@pytest.mark.parametrize("bits", [False, True])
def test_token_files_round_trip(spark, bits):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORD_BPE)
    texts = [*ODD_TEXTS, "It's <|endoftext|> Ünï'll don't... x|y É́á!", "Wörter, Wörter. 123 a1b2", "a" * 3000 + " end"]
    ids = list(range(len(texts), 0, -1))
    path = planes.write_token_files(documents(spark, texts, ids), WORD_BPE, bits=bits, block_ids=64, file_bytes=40_000)
    got = sorted(planes.read_token_files(spark, path).collect(), key=lambda r: r.doc_id)
    start = 0
    for r, (doc, text) in zip(got, sorted(zip(ids, texts))):
        want = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc, start, len(want), zlib.crc32(want.tobytes()))
        start += len(want)
    assert len(got) == len(texts)
    again = planes.write_token_files(documents(spark, ["b c", "a", "z", None], [3, 3, None, None]), WORD_BPE)
    rows = sorted(planes.read_token_files(spark, again).collect(), key=lambda r: r.start)
    assert [(r.doc_id, r.n_tokens) for r in rows] == [(-(1 << 63), 1), (-(1 << 63), 2), (3, 2), (3, 3)]
    empty = planes.write_token_files(documents(spark, []), WORD_BPE)
    assert planes.read_token_files(spark, empty).count() == 0


@given(st.lists(st.text("abXYZÉéßİıſǅªºŉ.,'|!<>0١½中ΑΣς\u0301\u0345 \n\x85", max_size=30), max_size=6))
@settings(max_examples=200, deadline=None)
def test_cached_words_encode_as_whole_texts(texts):
    want = [ENCODER.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert [ids.tolist() for ids in ENCODER.encode(texts)] == want


def test_digest_is_of_code_points():
    turns = [("user", "é"), ("assistant", "</s>ü")]
    text, spans = chat.format_turns(turns)
    said = "".join(chat.unescape(text[s:e]) for s, e in spans)
    assert hashlib.sha256(said.encode()).hexdigest() == hashlib.sha256("</s>ü".encode()).hexdigest()


def test_registered_token_counts_are_those_of_plain_longest_match(spark, tmp_path):
    import json

    pieces = set(json.load(open(WORD_BPE))["model"]["vocab"])
    texts = [*ODD_TEXTS[:5], "Hello wonderful worlds", "naïve ünïcode", "a1b2 don't x|y", "supercalifragilistic " * 3]
    documents(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    for r in queries.op2_token_counts(spark, str(tmp_path)).collect():
        want = 0
        for word in wordpiece._WORD.findall((texts[r.doc_id] or "").lower()):
            word, at, n = word + "</w>", 0, 0
            while at < len(word):
                ends = [e for e in range(len(word), at, -1) if word[at:e] in pieces]
                if not ends:
                    n = 0
                    break
                at, n = ends[0], n + 1
            want += n or 1
        assert r.n_tokens == want, texts[r.doc_id]


def test_registered_classifiers_keep_their_folds(spark, tmp_path):
    texts = [("good calm words of prose " if i % 3 else "BAD!! $$ CLICK zzurt ") * (2 + i % 5) for i in range(90)]
    documents(spark, [*texts, None], [*range(90), None]).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i % 3 != 0), int(i % 3 == 0)) for i in range(90)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for query, folds, fold, least in ((queries.op7_toxicity, 4, 2, 0.3), (queries.op8_quality, 3, 1, 0.5)):
        got = query(spark, str(tmp_path))
        assert [(f.name, f.dataType.simpleString()) for f in got.schema] == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
        rows = got.collect()
        assert len(rows) == 91 and all(0 <= r.score <= 1 and r.predicted == (r.score >= least) for r in rows)
        assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % folds == fold) for r in rows)
