"""Each operator against a brute-force version, a round trip or held-out labels, and on odd rows."""

import hashlib
import heapq
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerleaf.llm import bpe, dense_search, html_extract, language_id, minhash, mixing, ordinal, pii, quality_rules, queries, resampling, sharding, telephony, token_counts

ODD = "doc_id long, text string, lang string, source string, n_chars long, size int, kept int, shard string, row string, n string, bin string, node string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty, blank and long texts, ties, repeated rows, columns of clashing names."""
    rows = [(1, "a b c d e f", "en", "s1"), (1, "a b c d e f", "en", "s1"), (2, "a b c d e f", None, None), (3, None, "de", "s2"), (4, "", "en", "s2"), (5, " \n\t", "en", "s1"), (None, "g h i", "en", "s1"), (6, "word " * 20_000, "en", "s1"), (7, "x" * 50_000, None, "s3"), (None, None, None, None), (8, "Éà ß 日本 🎉", "fr", "s3")]
    return spark.createDataFrame([(*r, None, 1, 2, "s", "r", "n", "b", "k") for r in rows], ODD)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, 1, 1), (None, 1, 0), (3, None, 0), (9, 1, 0)], "doc_id long, quality int, toxic int")


def test_odd_rows_keep_their_number(spark, odd, labels):
    n = odd.count()
    none = labels.limit(0)
    assert quality_rules.apply_rules(odd, labels).count() == n
    assert language_id.identify(odd).count() == n
    assert sharding.shard_documents(odd).count() == n
    assert pii.find(odd).count() == n
    assert mixing.take(odd).count() == n
    assert telephony.media_report(telephony.with_pcm(telephony.store(odd))).count() == n
    assert ordinal.classify(odd, labels).count() == n
    assert ordinal.classify(odd, none).count() == n
    assert bpe.digests(odd, queries.RANKS, queries.PATTERN).count() == n
    assert minhash.near_duplicates(odd, 3, 85).count() == n
    assert pii.redact(odd).columns == odd.columns


def test_empty_tables(spark, odd, labels):
    none = odd.limit(0)
    for made in (
        quality_rules.apply_rules(none, labels), language_id.identify(none), sharding.shard_documents(none), pii.find(none), mixing.take(none),
        mixing.mixed_rows(none), telephony.media_report(telephony.with_pcm(telephony.store(none))), ordinal.classify(none, labels), bpe.digests(none, queries.RANKS, queries.PATTERN), minhash.near_duplicates(none),
    ):
        assert made.count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_extract.extract(pages).count() == 0


# 1. quality rules


def repeats(words):
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    twice = {w for w in windows if windows.count(w) > 1}
    return len({i + k for i, w in enumerate(windows) if w in twice for k in range(3)})


def test_counts_against_brute_force():
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choices(["a", "b", "a b", " ", "\n", "#", "é", "\t"], k=rng.randint(0, 40)))
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        m = quality_rules.measure(text)
        assert (m["n_words"], m["word_chars"], m["n_symbols"]) == (len(words), sum(map(len, words)), text.count("#"))
        assert m["n_dup_lines"] == len(lines) - len(set(lines))
        assert m["n_repeat_words"] == repeats(words), text


def test_binomial_tail_is_exact():
    for n, p in ((5, 0.3), (40, 0.05), (200, 0.01)):
        exact = np.cumsum([math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(n + 1)])
        assert np.allclose(quality_rules.binomial_tail(np.arange(n + 1), n, p), exact)


def test_taken_steps_bound_false_rejection():
    rng = np.random.default_rng(4)
    alpha, level, broken = 0.05, 0.05, 0
    for _ in range(300):  # a path whose rule sets truly reject 1, 3, 6, 10 and 20 % of good texts
        first = np.histogram(rng.random(400), [0, 0.01, 0.03, 0.06, 0.1, 0.2])[0]
        broken += quality_rules.last_step(first, np.full(5, 10_000), 400, alpha, level) >= 3
    assert broken <= 300 * level
    assert quality_rules.last_step(np.zeros(5, int), np.ones(5, int), 10, alpha, level) == 0


def brute_kept(docs, labels, alpha, delta):
    """``{doc_id: kept}`` and the steps taken, text by text."""
    low = {}
    for r in labels:
        if r.doc_id is not None and r.quality is not None:
            low[r.doc_id] = min(low.get(r.doc_id, r.quality), r.quality)
    found, texts = {}, {}
    for r in docs:
        m = quality_rules.measure(r.text)
        failed = m["n_words"] < 50 or 100 * m["n_repeat_words"] > 50 * m["n_words"]
        found[r.doc_id] = (r.lang or "", m, failed)
        if not failed and r.doc_id in low:
            key = (r.lang or "", r.key)
            texts[key] = (min(low[r.doc_id], texts[key][0]) if key in texts else low[r.doc_id], m, r.second)
    strata = {k[0] for k, v in texts.items() if v[2]}
    cuts = {}
    for s in {k[0] for k in texts}:
        mine = [v for k, v in texts.items() if k[0] == s]
        steps = []
        for at, (rule, grid) in enumerate(quality_rules.RULES.items()):
            most = 0
            for j, c in enumerate(grid):
                good = sum(q > 0 and m[rule] > c for q, m, second in mine if not second)
                bad = sum(q <= 0 and m[rule] > c for q, m, second in mine if not second)
                if bad > most:
                    most = bad
                    steps.append((good, at, j, rule, c))
        steps = [(rule, c) for _, _, _, rule, c in sorted(steps)]
        n = sum(q > 0 for q, _, second in mine if second)
        best, taken = 0, 0
        for k in range(1, len(steps) + 1):
            hit = [q > 0 for q, m, second in mine if second and any(m[rule] > c for rule, c in steps[:k])]
            tail = sum(math.comb(n, i) * alpha**i * (1 - alpha) ** (n - i) for i in range(sum(hit) + 1)) if n else 1
            if tail > delta / len(strata):
                break
            if (gain := len(hit) - sum(hit) - quality_rules.GOOD_WEIGHT * sum(hit)) > best:
                best, taken = gain, k
        cuts[s] = steps[:taken]
    return {i: not failed and not any(m[rule] > c for rule, c in cuts.get(s, [])) for i, (s, m, failed) in found.items()}, cuts


def test_kept_against_brute_force_rejects_junk_in_every_stratum(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id < 10000")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    docs = docs.join(labels.select("doc_id").distinct(), "doc_id")
    made = quality_rules.apply_rules(docs, labels).toPandas()
    keyed = docs.select("doc_id", "lang", "text", F.xxhash64("text").alias("key")).withColumn("second", F.pmod(F.xxhash64("key", F.lit("half")), F.lit(2)) == 1)
    kept, cuts = brute_kept(keyed.collect(), labels.collect(), quality_rules.ALPHA, quality_rules.DELTA)
    assert dict(zip(made.doc_id, made.kept, strict=True)) == kept
    assert all(cuts[s] for s in ("en", "de", "fr", "es"))
    judged = made.merge(labels.toPandas(), on="doc_id").merge(docs.select("doc_id", "lang").toPandas(), on="doc_id")
    judged = judged[~judged.base_failed]
    for _, g in judged.groupby("lang"):
        assert g[g.quality == 1].kept.mean() > 1 - quality_rules.ALPHA and g[g.quality == 0].kept.mean() < 0.5


# 2. HTML


def lcs_length(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_common_lines_against_dynamic_programming():
    rng = random.Random(2)
    for _ in range(2000):
        a, b = ([rng.randint(0, 4) for _ in range(rng.randint(0, 12))] for _ in range(2))
        x, y = html_extract.common_lines(a, b)
        assert len(x) == len(y) == lcs_length(a, b)
        assert [a[i] for i in x] == [b[j] for j in y] and x == sorted(set(x)) and y == sorted(set(y))


def test_shared_lines_go_without_an_article(spark):
    page = lambda own: f"<body><div>Shared top</div><p>{own} one, a longer text of its own.</p><p>{own} &amp; two</p><div>Shared end</div></body>"
    rows = [(1, "http://h/a/1", page("First")), (2, "http://h/a/2", page("Second")), (3, "http://other/a", page("Third")), (4, None, "<p>No url</p>"), (5, "http://h/b", None), (1, "http://h/a/1", page("First")), (6, "http://n/1", "<nav>menu</nav><article><h1>T</h1><p>x<br>y</p></article><footer>f</footer>")]
    made = {(r.page_id, r.text) for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert (2, "Second one, a longer text of its own. Second & two") in made
    assert (3, "Shared top Third one, a longer text of its own. Third & two Shared end") in made
    assert {(4, "No url"), (5, ""), (6, "T x y")} <= made


def test_pages_give_their_articles(spark, sf):
    import html

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in queries.op2_html_extract(spark, sf).collect():
        inner = re.search("<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        assert r.text == " ".join(html.unescape(re.sub("</?[bi]>", "", re.sub("<(?!/?[bi]>)[^>]*>", " ", inner))).split()) and r.n_chars == len(r.text)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<body><div class='layout has-sidebar'><p>One</p><div class=sidebar>x</div><p>Two</p></div></body>", "One Two"),
        ("<div class='withHeader'><p>Content</p></div>", "Content"),
        ("<article><h2 class='section-header'>Head</h2><div class='related-work'>Work</div><div class='related-posts'>no</div></article>", "Head Work"),
        ("<form><p>The whole page is a form, as servers make them.</p><nav>menu</nav></form>", "The whole page is a form, as servers make them."),
        ("<div id=header-wrap class=banner><p>All of the text of this page lies in here</p></div><p>x</p>", "All of the text of this page lies in here x"),
        ("<article><p class=ad>Buy<p>Text one<p>Text two</article><p>out", "Text one Text two"),
        ("<article><ul><li class=promo>Buy<li>Item</ul><p>After</article>", "Item After"),
        ("<article><table><tr><td class=ad>Buy<td>Cell<tr><td>Next</table></article>", "Cell Next"),
        ("<article><div><span class=ad>Buy</div><p>After</article>", "After"),
        ("<div class=comments><p>A long comment, longer than all other text</p></div><p>Text</p>", "Text"),
        ("<article><header><h1>Title</h1><p>By us</p></header><p>Body</p></article>", "Title Body"),
        ("<article><p>One</p><div class='share-price'>Share price rose to 5</div><p>Two</p></article>", "One Share price rose to 5 Two"),
        ("<article><div class='search-results'>Nine hits</div><div class='site-header'>no</div></article>", "Nine hits"),
        ("<article><h1>Main</h1><p>A long story</p></article><article><h2><a href=x>Teaser</a></h2><p>Short</p></article>", "Main A long story"),
        ("<article><h1>Main</h1><p>A long story</p></article><article><h2>Second</h2><p>Part</p></article>", "Main A long story Second Part"),
        ("<article><p>Story</p><aside><article><p>Teaser</p></article></aside></article>", "Story"),
        ("<div><a href=1>Home</a></div><div><a href=2>News</a></div><p>Text with a <a href=3>link</a></p>", "Text with a link"),
    ],
)
def test_elements_set_aside(page, text):
    assert html_extract.main_text(html_extract.lines_of(page), set()) == text


def brute_template(pages, me):
    """Lines of a page that its host's template holds, page by page over the whole host in the order of nearness."""
    found = []
    order = sorted(pages, key=lambda p: (p["path"], p["key"]))
    at = order.index(me)
    before, after = order[:at][::-1], order[at + 1 :]
    while (before or after) and len(found) < 3:
        near = lambda p: len([1 for x, y in zip(p["path"].split("/"), me["path"].split("/"), strict=False) if x == y])
        other = before.pop(0) if before and (not after or near(before[0]) >= near(after[0])) else after.pop(0)
        t = html_extract.shared_lines(me, other)
        if t:
            found.append(set(t))
    return {k for k in range(len(me["lines"])) if sum(k in t for t in found) >= min(2, len(found)) > 0}


def host_pages(spark, table):
    """The given pages as hosts build them: one menu and one footer a host, plain elements that say nothing of their part."""
    rows = []
    for r in spark.read.parquet(f"/root/testdata/{table}/pages.parquet").collect():
        host = re.match("https?://([^/]*)", r.url)[1]
        body = re.search("<article>(.*?)</article>", r.html, re.S)[1]
        menu = "".join(f"<div>{host} section {k}</div>" for k in range(5))
        rows.append((r.page_id, r.url, f"<html><body>{menu}<div>{body}</div><div>Imprint and terms of {host}</div></body></html>"))
    return rows


def test_differencing_decides_where_hosts_have_templates(spark):
    rows = host_pages(spark, "sf0.01")
    docs = spark.createDataFrame(rows, "page_id long, url string, html string")
    made = {r.page_id: r.text for r in html_extract.extract(docs).collect()}
    plain = {r.page_id: r.text for r in html_extract.extract(docs, differencing=False).collect()}
    articles = {r.page_id: r.text for r in html_extract.extract(spark.read.parquet("/root/testdata/sf0.01/pages.parquet")).collect()}
    hosts = {}
    for i, url, _ in rows:
        hosts.setdefault(re.match("https?://([^/]*)", url)[1], []).append(i)
    shared = [i for ids in hosts.values() if len(ids) > 3 for i in ids]
    assert len(shared) > 150 and all(made[i] != plain[i] for i in shared)
    assert np.mean([made[i] == articles[i] for i in shared]) > 0.98
    # the whole of the three largest hosts against the plain search
    import xxhash

    for host in sorted(hosts, key=lambda h: -len(hosts[h]))[:3]:
        pages = {}
        for i, url, page in rows:
            if i in hosts[host]:
                lines = html_extract.lines_of(page)
                path = re.sub("/+$", "", re.match("https?://[^/]*([^?#]*)", url)[1])
                digests = [xxhash.xxh64_intdigest(x.text) >> 1 for x in lines]
                pages[i] = {"path": path, "key": i, "host": host, "lines": digests, "chars": [len(x.text) for x in lines], "inside": [False] * len(lines), "aside": [x.aside for x in lines], "words": [html_extract.sketch(x.text) for x in lines], "texts": lines}
        for i, me in pages.items():
            assert made[i] == html_extract.main_text(me["texts"], brute_template(list(pages.values()), me)), i


def test_html_of_odd_rows(spark):
    kinds = "page_id long, url string, html string, key long, host string, path string, same string, lines string, template string"
    rows = [(1, "http://h/a", "<p>x y</p>"), (1, "http://h/a", "<p>x y</p>"), (None, None, None), (2, "http://h/b", ""), (3, "no url", "<p>z</p>"), (4, "http://h/c", "<p>" + "long words " * 60_000), (None, "http://h/d", "<p>x y</p>")]
    made = html_extract.extract(spark.createDataFrame([(*r, 1, "h", "p", "s", "l", "t") for r in rows], kinds)).collect()
    assert sorted((str(r.page_id), r.text[:9], r.n_chars) for r in made) == sorted([("1", "x y", 3), ("1", "x y", 3), ("None", "", 0), ("2", "", 0), ("3", "z", 1), ("4", "long word", 659_999), ("None", "x y", 3)])


def test_templates_of_short_pages_and_copies(spark):
    menu = "".join(f"<div>Menu entry number {k} of the site</div>" for k in range(12))
    page = lambda own: f"<body>{menu}<p>{own}</p><div>Bottom line of the host</div></body>"
    own = {1: "Rain fell over northern hills all night", 2: "Bakers want cheaper flour this winter", 3: "A football club sold its oldest stand"}
    long = "A new tunnel opened below the strait after nine years. " * 30
    rows = [(k, f"http://h/a/{k}", page(t)) for k, t in own.items()]
    rows += [(1, "http://h/a/1", page(own[1])), (4, "http://h/a/1?print=1", page(own[1])), (5, "http://h/a/4", page(long))]
    # a run of near copies by path: only the date differs, so no neighbour close by shows the template
    dated = lambda k: f"<p>Changed on 2{k} January of the year 2020</p><p>{own[1]} {own[2]}</p>"
    rows += [(10 + k, f"http://c/a/{k}", f"<body>{menu}{dated(k)}</body>") for k in range(6)] + [(20, "http://c/b/1", f"<body>{menu}<p>{own[3]}</p></body>")]
    made = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {k: made[k] for k in (1, 2, 3, 4)} == own | {4: own[1]} and made[5] == long.strip()
    assert [made[10 + k] for k in range(6)] == [f"Changed on 2{k} January of the year 2020 {own[1]} {own[2]}" for k in range(6)] and made[20] == own[3]


# 3. language


def test_languages_held_out(spark, sf):
    made = queries.op3_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    held = made[made.held_out]
    assert len(held) > 20 and (held.lang == held.lang_pred).mean() > 0.95
    assert {zlib.crc32(str(i).encode()) % 4 == 2 for i in held.doc_id} == {True}


def test_other_scripts(spark):
    """Languages of their own scripts, and two that share one, told apart on texts not learned from."""
    alphabets = {"zh": "的一是在不了有和人这中大为上个国我以要他", "ja": "のにはをたがでてとしれさいるな日本語人", "ko": "의이는을가에하다고로한지도사인대", "ru": "оеаинтсрвлкмдпуя", "bg": "аиеотнрсвлкъдпмз", "el": "αοιετσνρκπμλ"}
    rng = random.Random(17)
    stems = {k: ["".join(rng.choices(v, k=rng.randint(2, 5))) for _ in range(60)] for k, v in alphabets.items()}
    rows = [(i, " ".join(rng.choices(stems[lang], k=40)), lang) for i, lang in enumerate(list(alphabets) * 40)]
    made = language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).toPandas()
    held = made[made.held_out]
    assert len(held) > 30 and (held.lang_pred == [rows[i][2] for i in held.doc_id]).all()


def test_no_letter_is_no_language(spark):
    rows = [(i, "the cat sat on the mat \U0001f600", "en") for i in range(40)] + [(100, "\U0001f600\U0001f680", None), (101, "12 \u2013 \u20ac", None), (102, "\U00010400\U00010401", None), (103, "", None), (104, None, None)]
    made = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert [made[i][0] for i in (100, 101, 103, 104)] == ["und"] * 4 and made[102][0] == "en" and all(0 <= s <= 1 for _, s in made.values())
    for c in range(0x110000):
        assert (language_id._code_table()[c] > 0) == chr(c).isalpha()


def test_prediction_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    made = {r.doc_id: r for r in language_id.identify(docs).collect()}
    rows = docs.collect()
    sums = {}
    for r in rows:
        v = language_id.bundle([r.text])[0].astype(float)
        if r.lang and zlib.crc32(str(r.doc_id).encode()) % 4 != 2 and v.any():
            sums[r.lang] = sums.get(r.lang, 0) + v / np.linalg.norm(v)
    names = sorted(sums)
    unit = np.stack([sums[n] / np.linalg.norm(sums[n]) for n in names])
    centred = unit - unit.mean(0)
    for r in rows:
        v = language_id.bundle([r.text])[0].astype(float)
        if not v.any():
            assert made[r.doc_id].lang_pred == "und"
            continue
        d = v / np.linalg.norm(v) - unit.mean(0)
        cosine = centred @ d / np.linalg.norm(centred, axis=1) / np.linalg.norm(d)
        top = np.sort(cosine)[::-1]
        if top[0] - top[1] > 1e-4:
            assert made[r.doc_id].lang_pred == names[cosine.argmax()]
            assert made[r.doc_id].score == pytest.approx(1 / np.exp(20 * (cosine - cosine.max())).sum(), abs=1e-3)


def test_bundle_is_the_sum_of_bound_trigrams():
    text = "ab ba"
    codes = language_id.letters_of(text)
    first, second, third = language_id.letter_vectors()
    brute = sum(first[a].astype(int) * second[b] * third[c] for a, b, c in zip(codes, codes[1:], codes[2:], strict=False))
    assert np.array_equal(language_id.bundle([text, None, "12"])[0], brute)
    assert not language_id.bundle([None, "12"]).any()


# 4. shards


def heap_loads(sizes, shards):
    heap = [(0, s) for s in range(shards)]
    for size in sorted(sizes, reverse=True):
        load, s = heapq.heappop(heap)
        heapq.heappush(heap, (load + size, s))
    return sorted(x for x, _ in heap)


@pytest.mark.parametrize("table", ["sf0.001", "sf0.1"])
def test_lpt_and_slots(spark, table):
    docs = spark.read.parquet(f"/root/testdata/{table}/documents.parquet")
    made = queries.op4_shards(spark, f"/root/testdata/{table}").toPandas()
    groups = {}
    for r in docs.collect():
        t = r.text or ""
        groups[t] = groups.get(t, 0) + len(t.encode()) + 16
    assert sorted(made.groupby("shard")["size"].sum()) == heap_loads(groups.values(), 40)
    for _, g in made.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    assert made.groupby(["text_crc32", "size"]).shard.nunique().max() == 1


def test_lpt_in_one_step_equals_the_heap():
    rng = random.Random(12)
    for _ in range(300):
        shards = rng.randint(1, 7)
        sizes = {rng.randint(1, 40): rng.choice([1, 2, 5, 9 * shards, 200]) for _ in range(rng.randint(0, 9))}
        made = sharding.lpt(sizes.items(), shards)
        loads = [0] * shards
        for size, parts in made.items():
            assert sum(n for _, n in parts) == sizes[size]
            for s, n in parts:
                loads[s] += size * n
        assert sorted(loads) == heap_loads([x for x, n in sizes.items() for _ in range(n)], shards)


def test_many_groups_of_one_size(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.format_string("t%05d", "id").alias("text"), F.lit("x").alias("shard"))
    made = sharding.shard_documents(docs, 7).groupBy("shard").agg(F.count("*").alias("n"), F.max("slot").alias("last")).toPandas()
    assert sorted(made.n) == [571] * 4 + [572] * 3 and (made["last"] + 1 == made.n).all()


# 5. personal data


def brute_spans(text):
    out = []
    for kind, pattern in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True, "card": 12 <= len(digits) <= 19 and pii.luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), pii.BASE_KINDS.index(kind), m.end(), kind))
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


def test_base_spans_against_plain_patterns():
    rng = random.Random(3)
    for _ in range(5000):
        text = "".join(rng.choices(["a", "1", "2", "9", ".", "@", "-", " ", "+", "(", ")", "x.y", "127", "4111", "55"], k=rng.randint(0, 30)))
        assert pii.joined(pii.base_spans(text)) == brute_spans(text), text


def test_em_finds_the_reliable_labeler():
    rng = np.random.default_rng(5)
    truth = rng.random(4000) < 0.3
    noisy = lambda p: np.where(rng.random(4000) < p, truth, ~truth) * 2 - 1
    votes = np.stack([noisy(0.95), noisy(0.7), noisy(0.8)], 1).astype(float)
    shares, posterior = pii.reliabilities(votes, np.ones(4000))
    right = [(s[0, 0] + s[1, 2]) / 2 for s in shares]
    assert right[0] > 0.9 and right[1] < 0.78 and ((posterior > 0.5) == truth).mean() > 0.93


def test_em_on_the_table_equals_em_on_rows():
    rng = np.random.default_rng(6)
    rows = rng.choice([-1, 0, 1], (500, 3), p=[0.5, 0.2, 0.3])
    table, back, n = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
    _, made = pii.reliabilities(table.astype(float), n.astype(float))
    # the plain form, candidate by candidate
    posterior = [1 / (1 + math.exp(-2 * sum(r))) for r in rows.tolist()]
    for _ in range(pii.EM_ROUNDS):
        size = [sum(1 - p for p in posterior), sum(posterior)]
        share = [[[(sum((p if c else 1 - p) for p, r in zip(posterior, rows, strict=True) if r[k] == v) + pii.SMOOTHING) / (size[c] + 3 * pii.SMOOTHING) for v in (-1, 0, 1)] for k in range(3)] for c in (0, 1)]
        odds = [(size[c] + pii.SMOOTHING) / (len(rows) + 2 * pii.SMOOTHING) for c in (0, 1)]
        of = {tuple(v): [odds[c] * math.prod(share[c][k][int(v[k]) + 1] for k in range(3)) for c in (0, 1)] for v in table.tolist()}
        posterior = [of[tuple(r)][1] / sum(of[tuple(r)]) for r in rows.tolist()]
    assert np.allclose(made[back.ravel()], posterior, atol=1e-6)


def test_classifier_accepts_and_refuses(spark):
    """Planted personal data among planted look-alikes of the same forms: each kind has spans accepted and refused."""
    yes = {
        "secret": "token = \"{:040x}\" here", "iban": "iban: DE89370400440532013000 bank", "spelled_email": "mail to jo{} [at] example [dot] com now",
        "ssn": "social security 536-90-{:04d} ok", "local_phone": "phone (030) 555-{:04d} please", "name": "Dear Mr. Peter Malone{} signed",
    }
    no = {
        "secret": "a word lotsofletterswithoutend of prose", "iban": "the part AB12 CDEF 34567 X of stock", "spelled_email": "they met at noon.so he left",
        "ssn": "build 000 12 {:04d} was made", "local_phone": "from 20 {:03d} 4512 units", "name": "The Northern Hills were green",
    }
    rng = random.Random(13)
    rows, kinds = [], list(yes)
    for i in range(600):
        kind, real = kinds[i % 6], rng.random() < 0.5
        form = (yes if real else no)[kind]
        value = {"secret": rng.getrandbits(160), "ssn": rng.randint(1000, 9999), "local_phone": rng.randint(100, 999) if not real else rng.randint(1000, 9999)}.get(kind, "")
        rows.append((i, f"some words {'x' * (i % 23)} before it, and " + form.format(value) + " then more of them", kind, real))
    docs = spark.createDataFrame(rows, "doc_id long, text string, kind string, real boolean")
    found = {r.doc_id: r.spans for r in pii.find(docs).collect()}
    for kind in kinds:
        mine = [(any(s.startswith(kind + ":") for s in found[i].split(",")), real) for i, _, k, real in rows if k == kind]
        assert np.mean([hit for hit, real in mine if real]) > 0.9, kind
        assert not any(hit for hit, real in mine if not real), kind


def test_refused_and_accepted_on_given_documents(spark):
    counts = pii.pattern_counts(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    model = pii.train(counts)
    accepted, refused = {}, {}
    for r in counts.collect():
        side = accepted if model.accepts(tuple(r)[:5]) else refused
        side[r.kind] = side.get(r.kind, 0) + r.n
    assert accepted["secret"] > 5 and refused["secret"] > 50 and refused["name"] > 500 and "name" not in accepted


def test_taken_stretches_against_brute_force():
    rng = random.Random(14)
    for _ in range(300):
        spans = [pii.Span("ip", a, a + rng.randint(1, 9)) for a in (rng.randint(0, 80) for _ in range(rng.randint(0, 6)))]
        held, taken = [(s.start, s.end) for s in spans], pii._Taken(spans)
        for _ in range(30):
            a = rng.randint(0, 90)
            b = a + rng.randint(1, 6)
            free = all(b <= x or y <= a for x, y in held)
            assert taken.free(a, b) == free
            if free:
                held.append((a, b))


def test_secrets_are_added_and_redacted(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = {r.doc_id: r.spans for r in pii.find(docs).collect()}
    hexes = [r.doc_id for r in docs.collect() if re.search('token = "[0-9a-f]{40}"', r.text)]
    assert hexes and all("secret" in found[i] for i in hexes)
    clean = [r.doc_id for r in docs.collect() if not re.search("[0-9]", r.text)]
    assert all(found[i] == "" for i in clean)
    left = pii.redact(docs).toPandas()
    assert all(brute_spans(t) == "" for t in left.text) and (left.n_chars == left.text.str.len()).all()


# 6. mixing


def test_mix_meets_targets(spark, sf):
    made = mixing.take(spark.read.parquet(f"{sf}/documents.parquet"), keep=["source"]).toPandas()
    sizes = made.groupby("source")["size"].sum()
    order = sorted(sizes.index)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, open_ = {}, set(order)
    left = 1.5 * sizes.sum()
    while True:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        if not full:
            target |= {s: level * weight[s] for s in open_}
            break
        for s in full:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= full
    by = made.groupby("source").agg(target=("target", "first"), taken=("taken", "sum"), biggest=("size", "max"))
    for s in order:
        assert by.target[s] == pytest.approx(target[s]) and abs(by.taken[s] - target[s]) <= by.biggest[s]
    assert (made.taken <= 2 * made["size"]).all()


def brute_mix(made, target):
    """Copies of the documents of one source, ``{id: size}``, by falling preference and Pareto order."""
    prefer = {i: len(f"{n:b}") for i, n in made.items()}
    held, wanted = 0, {}
    for top in sorted(set(prefer.values()), reverse=True):
        rate = (target - 2 * held) / sum(prefer[i] * n for i, n in made.items() if prefer[i] <= top)
        if rate * top < 2:
            wanted |= {i: rate * prefer[i] for i in made if prefer[i] <= top}
            break
        held += sum(n for i, n in made.items() if prefer[i] == top)
        wanted |= {i: 2.0 for i in made if prefer[i] == top}
    rank = []
    for i in made:
        u = (int(hashlib.md5(f"{i}:mix".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        p = wanted[i] - math.floor(wanted[i])
        rank.append(((u / (1 - u)) / (p / (1 - p)) if p else math.inf, i, math.floor(wanted[i])))
    left = target - sum(f * made[i] for _, i, f in rank)
    so_far, taken = 0, {}
    for q, i, f in sorted(rank):
        so_far += made[i] if q < math.inf else 0
        taken[i] = f + (q < math.inf and so_far - made[i] / 2 <= left)
    return taken


def test_pareto_order_against_brute_force(spark):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.repeat(F.lit("w "), (F.col("id") % 90 + 1).cast("int")).alias("text"))
    for share in (0.7, 1.9):
        made = {r.doc_id: r for r in mixing.take(docs, share=share).collect()}
        assert {i: r.copies for i, r in made.items()} == brute_mix({i: r.size for i, r in made.items()}, share * sum(r.size for r in made.values()))


def test_inclusion_follows_preference(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit("a b c").alias("text"))
    made = mixing.take(docs, share=0.5, preference=F.when(F.col("doc_id") % 2 == 0, 3).otherwise(1)).toPandas()
    by = made.groupby(made.doc_id % 2).copies.mean()
    assert abs(by[0] - 0.75) < 0.04 and abs(by[1] - 0.25) < 0.04


def test_repeated_rows_and_null_ids_meet_the_target(spark):
    rows = [(7, "one two three", "s")] * 500 + [(None, "four five", "s")] * 400 + [(i + 10, "a b c d", "s") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)
    made = mixing.take(docs, share=0.6).toPandas()
    assert len(made) == 950 and abs(made.taken.sum() - made.target[0]) <= 4
    again = mixing.take(docs.repartition(3), share=0.6).toPandas()
    key = ["doc_id", "size", "copies"]
    assert made.fillna(-1).groupby(key).size().to_dict() == again.fillna(-1).groupby(key).size().to_dict()
    assert abs(mixing.mixed_rows(docs, share=0.6).count() - made.copies.sum()) == 0


# 7. telephony


def adpcm_scalar(block):
    head, index = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
    out = [head]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = int(telephony.ADPCM_STEPS[index])
            change = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
            head = max(-32768, min(32767, head - change if code & 8 else head + change))
            index = max(0, min(88, index + int(telephony.ADPCM_INDEX[code])))
            out.append(head)
    return out


def test_codecs():
    blocks = np.random.default_rng(6).integers(0, 256, (7, telephony.BLOCK)).astype(np.uint8)
    assert telephony.decode_adpcm(blocks).tolist() == [adpcm_scalar(bytes(b)) for b in blocks]
    assert telephony.mulaw_table()[[0x00, 0x80, 0xFF, 0x7F]].tolist() == [-32124, 32124, 0, 0]
    assert telephony.alaw_table()[[0x55, 0xD5, 0x2A, 0xAA]].tolist() == [-8, 8, -32256, 32256]


def plain_resampled(pcm):
    """Sample by sample: the low-pass from its formula, edges held."""
    ideal = [math.sin(math.pi * (k + 0.5)) / (math.pi * (k + 0.5)) * math.cos(math.pi * (k + 0.5) / (2 * telephony.TAPS + 1)) ** 2 for k in range(telephony.TAPS)]
    fixed = [round(c / sum(ideal) * 8192) for c in ideal]
    fixed[0] += 8192 - sum(fixed)
    at = lambda i: int(pcm[min(max(i, 0), len(pcm) - 1)])
    out = []
    for i in range(len(pcm)):
        total = sum(c * (at(i - k) + at(i + 1 + k)) for k, c in enumerate(fixed))
        out += [at(i), max(-32768, min(32767, (total + 8192) >> 14))]
    return out


def test_resampler(monkeypatch):
    monkeypatch.setattr(telephony, "STEP_SAMPLES", 64)
    pcm = np.random.default_rng(15).integers(-32768, 32768, 300).astype(np.int16)
    assert telephony.resample_double(pcm).tolist() == plain_resampled(pcm)
    tone = np.round(12000 * np.sin(2 * np.pi * 1000 * np.arange(400) / 8000)).astype(np.int16)
    exact = 12000 * np.sin(2 * np.pi * 1000 * np.arange(800) / 16000)
    assert np.abs(telephony.resample_double(tone) - exact)[40:-40].max() < 120
    assert telephony.resample_double(np.array([5], np.int16)).tolist() == [5, 5]


def test_media_round_trip(spark, odd):
    texts = odd.where("doc_id is not null").dropDuplicates(["doc_id"]).select("doc_id", "text").toPandas().set_index("doc_id").text
    stored = telephony.with_pcm(telephony.store(odd)).where("doc_id is not null")
    samples = {r.doc_id: bytes(r.pcm) for r in stored.collect()}
    for r in telephony.media_report(stored).collect():
        raw = (texts[r.doc_id] or "").encode()
        payload = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        if len(payload) > 9000:
            continue
        codec = ["mulaw", "alaw", "adpcm"][zlib.crc32(payload) % 3]
        if codec == "adpcm":
            pcm = [x for at in range(0, len(payload), 192) for x in adpcm_scalar(payload[at : at + 192])]
        else:
            pcm = [int((telephony.mulaw_table() if codec == "mulaw" else telephony.alaw_table())[b]) for b in payload]
        full = plain_resampled(pcm)
        assert np.frombuffer(samples[r.doc_id], "<i2").tolist() == full and r.pcm_bytes == 2 * len(full)
        crossings = sum((a >= 0) != (b >= 0) for a, b in zip(full, full[1:], strict=False))
        assert r.feature == f"{codec} n={len(full)} peak={max(map(abs, full))} power={sum(x * x for x in full) // len(full)} crossings={crossings}"


# 8. ordinal classifier


def test_ordinal_orders_grades():
    rng = np.random.default_rng(7)
    found, grade = [], []
    for _ in range(1500):
        g = int(rng.integers(0, 3))
        words = {0: [1, 2], 1: [3], 2: []}[g] + rng.integers(10, 60, 8).tolist()
        found.append(np.unique(words))
        grade.append(g)
    model = ordinal.fit_rows(found[:1200], np.array(grade[:1200]))
    below = model.below(model.score([f.tolist() for f in found[1200:]]))
    expected, y = (1 - below).sum(1), np.array(grade[1200:])
    assert np.all(np.diff(model.thresholds) > 0)
    assert ((1 - below[:, -1] >= 0.5) == (y == 2)).mean() > 0.95 and expected[y == 0].mean() < expected[y == 1].mean() < expected[y == 2].mean()


def test_fit_against_full_batch_likelihood():
    """Small steps up the exact likelihood of all rows at once reach no more than the fit does, and the same order of rows."""
    rng = np.random.default_rng(16)
    truth = np.where(rng.random(60) < 0.5, 0, rng.normal(0, 1.5, 60))
    found = [np.unique(rng.integers(0, 60, 8)) for _ in range(1500)]
    z = np.array([truth[f].sum() for f in found])
    grade = (z + rng.logistic(size=1500) > -0.5).astype(int) + (z + rng.logistic(size=1500) > 1.5)
    x = np.zeros((1500, 60))
    for i, f in enumerate(found):
        x[i, f] = 1

    def likelihood(w, t):
        below = np.concatenate([np.zeros((1500, 1)), 1 / (1 + np.exp(-(t[None, :] - (x @ w)[:, None]))), np.ones((1500, 1))], 1)
        return np.log(np.maximum(below[np.arange(1500), grade + 1] - below[np.arange(1500), grade], 1e-12)).mean()

    w, t = np.zeros(60), np.array([-0.5, 0.5])
    for _ in range(4000):
        below = 1 / (1 + np.exp(-(t[None, :] - (x @ w)[:, None])))
        full = np.concatenate([np.zeros((1500, 1)), below, np.ones((1500, 1))], 1)
        upper, lower = full[np.arange(1500), grade + 1], full[np.arange(1500), grade]
        p, d = np.maximum(upper - lower, 1e-12), below * (1 - below)
        w = w + 1.0 * (x.T @ (upper + lower - 1)) / 1500
        t = t + 1.0 * np.array([(np.where(grade == k, d[:, k] / p, 0) - np.where(grade == k + 1, d[:, k] / p, 0)).mean() for k in (0, 1)])
    model = ordinal.fit_rows(found, grade)
    best, made = likelihood(w, t), likelihood(model.weights[:60], model.thresholds)
    assert best - 0.02 < made <= best + 1e-4
    assert np.corrcoef(x @ w, x @ model.weights[:60])[0, 1] > 0.99


def test_rating_against_plain_formulas(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = ordinal.fit(docs, labels)
    assert np.array_equal(model.weights, ordinal.fit(docs.repartition(7), labels).weights)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in ordinal.rate(docs, model).collect():
        z = sum(model.weights[b] for b in ordinal.features(texts[r.doc_id]))
        tails = [1 - 1 / (1 + math.exp(-(t - z))) for t in model.thresholds]
        assert r.expected_grade == pytest.approx(sum(tails), abs=2e-6) and r.p_top == pytest.approx(tails[-1], abs=2e-6) and r.kept == (r.p_top >= 0.8)


def test_quality_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id < 4000")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    train = labels.where(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) != 0)
    made = ordinal.classify(docs, train).join(labels.join(train.select("doc_id"), "doc_id", "left_anti"), "doc_id").toPandas()
    clean, low = made[(made.quality == 1) & (made.toxic == 0)], made[made.quality == 0]
    assert clean.kept.mean() > 0.97 and low.kept.mean() < 0.1


# 9. byte-level BPE


def test_bpe_equals_tiktoken(spark, sf):
    c = bpe.codec(queries.RANKS, queries.PATTERN)
    own = tiktoken.Encoding("own", pat_str=queries.PATTERN, mergeable_ranks=c.ranks, special_tokens={})
    rng = random.Random(8)
    texts = ["", "a" * 5000, "é  \n\n x", "ab" * 3000, "🎉 日本語 <|endoftext|>", "".join(rng.choices("abcde", k=9000)), *("".join(rng.choices("ab é#1\n'st", k=60)) for _ in range(300))]
    texts += [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()]
    for t, ids in zip(texts, c.encode_batch(texts), strict=True):
        assert ids == own.encode_ordinary(t) and c.decode(ids) == t.encode()
    assert [bpe.merge_word(w.encode(), c.ranks) for w in ("thereupon", "qzxj", "ééé")] == [own.encode_ordinary(w) for w in ("thereupon", "qzxj", "ééé")]
    ids = bpe.encode(spark.createDataFrame([(1, "hello world"), (2, None)], "doc_id long, text string"), public_tokenizers.path("byte_bpe_50k.tiktoken"), queries.PATTERN)
    assert {r.doc_id: bytes(r.decoded) for r in bpe.decode(ids, queries.RANKS, queries.PATTERN).collect()} == {1: b"hello world", 2: b""}


# 10. near duplicates


def brute_components(rows, size, percent):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets, parent = {}, {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
        parent[i] = i

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in range(len(ids)):
        for b in range(a):
            x, y = sets[ids[a]], sets[ids[b]]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(ids[a]), find(ids[b])
                parent[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize(("size", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_against_brute_force(spark, sf, size, percent):
    rng = random.Random(9)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    base = [f"w{rng.randint(0, 400)}" for _ in range(120)]
    for k in range(330):  # near copies around the threshold, more than a block of them, and small texts
        words = list(base)
        for _ in range(rng.randint(0, 7)):
            words[rng.randrange(len(words))] = f"v{rng.randint(0, 9)}"
        rows.append((10_000 + k, " ".join(words)))
    rows += [(20_000, "A b"), (20_001, "a B"), (20_002, ""), (20_003, None), (20_004, "a  b\n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    made = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs, size, percent).collect()}
    assert made == brute_components(rows, size, percent)


def test_signature_estimates_similarity():
    rng = np.random.default_rng(10)
    a = rng.integers(0, 2**63, 800).astype(np.uint64)
    b = np.concatenate([a[:700], rng.integers(0, 2**63, 100).astype(np.uint64)])
    same = (minhash.signature(a, 400) == minhash.signature(b, 400)).mean()
    assert abs(same - 700 / 900) < 0.08


# pipeline


def test_stages_against_brute_force(spark, sf):
    """Each stage of the pipeline, on what the one before has kept, against a plain version of it."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    by_id = lambda df: {r.doc_id: r.asDict() for r in df.collect()}
    model = ordinal.fit(docs, labels)
    rated = corpus_pipeline.saved(corpus_pipeline.quality(spark, docs, sf))
    top = lambda t: 1 - 1 / (1 + math.exp(-(model.thresholds[-1] - sum(model.weights[b] for b in ordinal.features(t)))))
    every = by_id(docs)
    assert by_id(rated) == {i: r for i, r in every.items() if ordinal.features(r["text"]) and round(top(r["text"]), 6) >= 0.8}
    once = corpus_pipeline.saved(corpus_pipeline.one_of_each_group(spark, rated, sf))
    groups = brute_components([(r.doc_id, r.text) for r in rated.collect()], 5, 80)
    assert by_id(once) == {i: r for i, r in by_id(rated).items() if groups[i][1] == i}
    clean = corpus_pipeline.saved(corpus_pipeline.redacted(spark, once, sf))
    spans, before = pii.fit(once), by_id(once)
    for i, r in by_id(clean).items():
        text = before[i]["text"]
        assert r["text"] == pii.redacted_text(text, pii.spans_of(text, spans)[1]) and brute_spans(r["text"]) == "" and r["n_chars"] == len(r["text"])
    mix = corpus_pipeline.saved(corpus_pipeline.mixed(spark, clean, sf))
    sizes = {}
    for i, r in by_id(clean).items():
        sizes.setdefault(r["source"], {})[i] = len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))
    goals = {r.source: r.target for r in mixing.take(clean, keep=["source"]).select("source", "target").distinct().collect()}
    want = {i: n for s, made in sizes.items() for i, n in brute_mix(made, goals[s]).items() if n and made[i]}
    assert {r.doc_id: r["count"] for r in mix.groupBy("doc_id").count().collect()} == want
    own = tiktoken.Encoding("own", pat_str=queries.PATTERN, mergeable_ranks=bpe.codec(queries.RANKS, queries.PATTERN).ranks, special_tokens={})
    texts = {r.doc_id: r.text for r in mix.collect()}
    for r in corpus_pipeline.tokens(spark, mix, sf).collect():
        ids = own.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())


def test_stages_on_odd_rows_and_empty_tables(spark, odd):
    sf = "/root/testdata/sf0.001"
    for _, stage in corpus_pipeline.STAGES:
        made = stage(spark, odd, sf)
        assert stage(spark, odd.limit(0), sf).count() == 0
        if stage is not corpus_pipeline.tokens:
            assert made.columns == odd.columns
        assert made.count() <= 2 * odd.count()


def test_pipeline(spark, odd):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "MinHash near-dedup", "PII", "mixing sources to target weights", "byte-level BPE"]
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = corpus_pipeline.quality(spark, docs, sf)
    assert kept.columns == docs.columns and 0 < kept.count() <= docs.count()
    text = " ".join(f"w{i}" for i in range(60))
    few = spark.createDataFrame([(1, text + " mail a.b@c.org now", "en", "s", 5, "x"), (2, text + " mail a.b@c.org now", "en", "s", 5, "x"), (3, "other words " * 30, "en", "s", 5, "x"), (None, "no id here", None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long, kept string")
    once = corpus_pipeline.one_of_each_group(spark, few, sf)
    assert sorted(str(r.doc_id) for r in once.collect()) == ["1", "3", "None"]
    hidden = corpus_pipeline.redacted(spark, once, sf).collect()
    assert [r.text for r in hidden if r.doc_id == 1] == [text + " mail <EMAIL> now"] and hidden[0].asDict().keys() == {*few.columns}
    mix = corpus_pipeline.mixed(spark, once, sf)
    assert mix.columns == few.columns and mix.count() >= 2
    assert corpus_pipeline.tokens(spark, mix, sf).count() == mix.count()
    assert corpus_pipeline.quality(spark, odd, sf).columns == odd.columns


def test_pipeline_keeps_one_of_repeated_rows(spark):
    text, other = " ".join(f"w{i}" for i in range(60)), " ".join(f"v{i}" for i in range(60))
    rows = [(1, text, "s"), (1, text, "s"), (2, text, "s"), (None, text + " end", "s"), (None, other, "s"), (None, other, "s"), (3, "quite another text", "t"), (None, None, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    once = corpus_pipeline.one_of_each_group(spark, docs, "/root/testdata/sf0.001")
    assert once.columns == docs.columns
    assert sorted(map(str, map(tuple, once.collect()))) == sorted(map(str, [(1, text, "s"), (None, other, "s"), (3, "quite another text", "t"), (None, None, "s")]))


# 11. token counts


@pytest.fixture(scope="module")
def word_bpe():
    whole = tokenizers.Tokenizer.from_file(queries.WORD_BPE)
    return lambda text: len(whole.encode(text or "", add_special_tokens=False).ids)


def test_token_counts_equal_the_library(spark, sf, word_bpe):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    made = queries.QUERIES["op11_prefix_counts"](spark, sf).collect()
    assert len(made) == len(texts)
    for r in made:
        text, n = texts[r.doc_id], word_bpe(texts[r.doc_id])
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((text or "").encode()), n, n > 2048)
        assert word_bpe((text or "")[: r.fit_chars]) == r.fit_tokens <= 2048
        if n > 2048:  # one code point more is too much
            assert word_bpe(text[: r.fit_chars + 1]) > 2048


PIECES = ["a", "s", "re", "'", "'re", "'s", "'ll", "!", "<|endoftext|>", "<|startoftext|>", "<|", "|>", " ", "\n", "\x0b", "É", "é", "e\u0301", "e\u0308\u0301", "ß", "日本", "🎉", "İ", "가", "\u1100\u1161\u11a8", "ﬁ", "12", "½", "²", "ª", "µ", "×", "the", "ing", "un", "aa", "aaa", "\xa0", "\u3000", "\x1c", "Σ", "ẞ", "क़", "...", "--", "</w>", "\0"]


def test_every_prefix_against_the_library(word_bpe):
    known, rng = token_counts.Prefixes(queries.WORD_BPE), random.Random(11)
    for _ in range(600):
        text = "".join(rng.choices(PIECES, k=rng.randint(1, 12)))
        table = known.table(text)
        assert len(table) == len(text) and table[-1] == word_bpe(text)
        for n, count in enumerate(table, 1):
            assert count in (token_counts.NO_CUT, word_bpe(text[:n])), (text, n)
        budget = rng.randint(0, 8)
        within = [n for n, count in enumerate(table, 1) if count <= budget]
        assert known.answer(text, budget)[:2] == (table[-1], within[-1] if within else 0), (text, budget)


def test_white_space_is_that_of_the_tokenizer():
    form = tokenizers.Tokenizer.from_file(queries.WORD_BPE).normalizer.normalize_str
    for c in (*range(0xD800), *range(0xE000, 0x30000)):
        assert (form(f"a{chr(c)}b") == "a b") == (token_counts.BREAK.match(chr(c)) is not None), hex(c)


def test_long_words_and_blocks(word_bpe, monkeypatch):
    known, rng = token_counts.Prefixes(queries.WORD_BPE), random.Random(12)
    for text in ("x" * 20_000, "".join(rng.choices("abcdefgh", k=20_000)), "日本語" * 5_000, "e\u0301" * 5_000):
        total, chars, tokens = known.answer(text, 100)
        assert total == word_bpe(text) and tokens == word_bpe(text[:chars]) <= 100
    monkeypatch.setattr(token_counts, "BLOCK", 50)
    monkeypatch.setattr(token_counts, "WORDS_KEPT", 20)
    text = " ".join(rng.choices(PIECES, k=500)) + "<|endoftext|>"
    known.learn([text])
    assert known.answer(text, 300)[0] == word_bpe(text)
    assert word_bpe(text[: known.answer(text, 300)[1]]) <= 300


def test_stored_tables_answer_budgets(spark, odd, word_bpe):
    text = "It's the <|endoftext|> of e\u0301 re-encoding"
    stored = token_counts.prefix_counts(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string"), queries.WORD_BPE)
    rows = stored.select("doc_id", "counts", *[token_counts.tokens_of("counts", n).alias(f"t{n}") for n in (0, 4, 99)], token_counts.longest_within(F.col("counts"), 5).alias("fit")).orderBy("doc_id").collect()
    assert rows[0].t0 == 0 and rows[0].t4 == word_bpe(text[:4]) and rows[0].t99 == word_bpe(text)
    assert word_bpe(text[: rows[0].fit]) <= 5 < word_bpe(text[: rows[0].fit + 1])
    assert rows[0].counts[text.index("\u0301") - 1] is None
    assert [(r.counts, r.t4, r.fit) for r in rows[1:]] == [([], 0, 0)] * 2
    made = token_counts.count(odd, queries.WORD_BPE, 2048).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in made) == sorted((r.doc_id or 0, word_bpe(r.text)) for r in odd.collect())
    assert token_counts.count(odd.limit(0), queries.WORD_BPE, 2048).count() == 0


# 12. ranked search


def plain_search(docs, items, k):
    """Scores by the formula, item by item and document by document, in Python's whole numbers."""

    def terms(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))

    counted = [(doc_id, terms(text)) for doc_id, text in docs]
    n_docs, total = sum(1 for _, w in counted if w), sum(len(w) for _, w in counted)
    df = {}
    for _, w in counted:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    out = set()
    for item, text in set(items):
        found = []
        for nth, (doc_id, w) in enumerate(counted):
            score = 0
            for t in set(terms(text)) & set(w):
                m = 50 + (50 * len(w) * n_docs) // total
                score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * w.count(t)) // (1000 * w.count(t) + 20 * m))
            if score > 0:
                found.append((-score, doc_id is None, doc_id or 0, nth, doc_id))
        out |= {(item, rank, x[4], -x[0]) for rank, x in enumerate(sorted(found)[:k], 1)}
    return out


def test_search_against_brute_force(spark, odd, monkeypatch):
    rng = random.Random(12)
    words = ["a", "b", "Cc", "dd.d", "é", "日本", "f_g", "h", "0", "ii", "jj", "kk"]
    docs = [(i % 90 if i % 31 else None, " ".join(rng.choices(words, k=rng.choice([0, 1, 3, 30])))) for i in range(200)] + [(7, None), (8, "--")]
    items = [(i, " ".join(rng.choices([*words, "nowhere"], k=rng.randint(0, 9)))) for i in range(30)] + [(30, None), (0, ""), (31, "ii"), (31, "ii")]
    frame, asked = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    expected = plain_search(docs, [x for x in items if x[1]], 5)
    assert {tuple(r) for r in dense_search.search(frame, asked, 5).collect()} == expected
    monkeypatch.setattr(dense_search, "MOST_TERMS", 12)  # several passes, tiles, parts of an item's terms and slices
    monkeypatch.setattr(dense_search, "ITEMS", 2)
    monkeypatch.setattr(dense_search, "TERMS", 3)
    assert {tuple(r) for r in dense_search.search(frame.repartition(3), asked, 5).collect()} == expected
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert {tuple(r) for r in dense_search.search(odd, spark.createDataFrame([(1, "A g word"), (2, "日本")], "item_id long, text string"), 3).collect()} == plain_search(rows, [(1, "a g word"), (2, "日本")], 3)
    assert dense_search.search(odd.limit(0), asked).count() == dense_search.search(odd, asked.limit(0)).count() == 0


def test_products_stay_exact():
    weights = {i: 40_000 for i in range(300_000)}
    made = dense_search.tile([(1, list(weights))], weights)
    assert all(int(w.sum()) * dense_search.IMPACT < dense_search.EXACT and w.shape[1] <= dense_search.TERMS for _, w in made.parts)
    assert sum(len(t) for t, _ in made.parts) == len(weights)
    tf, n = np.array([1, 3, 10**6]), np.array([10, 10**13, 10**12])
    assert dense_search.impacts(tf, n, 10**9, 10**14).tolist() == [(10**9 * a) // (1000 * a + 20 * (50 + (50 * b * 10**9) // 10**14)) for a, b in zip(tf.tolist(), n.tolist())]


# 13. importance resampling


def plain_runs(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return len(words), [zlib.crc32(" ".join(words[i : i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def plain_resample(docs, target):
    s, t = [0] * 10_000, [0] * 10_000
    for counts, texts in ((s, [x for _, x in docs]), (t, target)):
        for text in texts:
            for b in plain_runs(text)[1]:
                counts[b] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + 10_000) / ((a + 1) * (sum(t) + 10_000)))) for a, b in zip(s, t)]
    rows = []
    for doc_id, text in docs:
        n, runs = plain_runs(text)
        h = int(hashlib.sha256(f"42:{'null' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in runs)
        rows.append((doc_id, n, len(runs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    places = {}
    for place, r in enumerate(able, 1):
        places.setdefault(r, []).append(place if place <= 5 * len(able) // 100 else None)
    return sorted(((*r, places[r].pop(0) if r in places else None) for r in rows), key=repr)


def test_resampling_against_brute_force(spark, odd):
    rng = random.Random(13)
    words = ["a", "Bc", "dd", "é", "日本", "x" * 70, "q" * 300, "f_g", "h.i", "0"]
    docs = [(i % 150 if i % 41 else None, " ".join(rng.choices(words, k=rng.choice([0, 1, 2, 3, 25, 60])))) for i in range(150)]
    docs += [(900, " ".join(words * 3))] * 5 + [(901, None), (902, " - ")]
    target = [" ".join(rng.choices(words[:4], k=30)) for _ in range(9)] + [None, ""]
    goals = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    for given in (docs, [(r.doc_id, r.text) for r in odd.collect()]):
        made = resampling.resample(spark.createDataFrame(given, "doc_id long, text string").repartition(3), goals)
        assert sorted(map(tuple, made.collect()), key=repr) == plain_resample(given, target)
    assert resampling.resample(odd, goals).columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert resampling.resample(odd.limit(0), goals).count() == 0
    assert resampling.resample(odd, goals.limit(0)).count() == odd.count()


def test_payloads_compose_to_the_hash_of_the_run():
    rng = random.Random(14)
    for _ in range(60):
        texts = [" ".join("".join(rng.choices("ab é日", k=rng.choice([1, 5, 64, 65, 400]))) for _ in range(rng.randint(0, 9))) for _ in range(5)]
        plain = [resampling.plain(t.encode()) for t in texts]
        sizes, places, found = resampling.Dictionary(plain).buckets(plain)
        for i, t in enumerate(texts):
            assert (sizes[i], sorted(found[places == i].tolist())) == (plain_runs(t)[0], sorted(plain_runs(t)[1]))


def test_columns_of_any_name_pass_near_dedup(spark, sf):
    docs = spark.createDataFrame([(1, "a b c d e f g", "mine", 5), (2, "a b c d e f g", "yours", 6), (3, None, "x", 7), (None, "h i j k l m", "y", 8)], "doc_id long, text string, _id string, n long")
    made = corpus_pipeline.one_of_each_group(spark, docs, sf)
    assert made.columns == docs.columns and {tuple(r) for r in made.collect()} == {(1, "a b c d e f g", "mine", 5), (3, None, "x", 7), (None, "h i j k l m", "y", 8)}
    assert corpus_pipeline.one_of_each_group(spark, docs.limit(0), sf).count() == 0
