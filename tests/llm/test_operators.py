"""Each operator against a brute-force version, and on awkward rows."""

import collections
import hashlib
import html as entities
import itertools
import math
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from gleanframe.llm import decontaminate, html, jaccard, links, lm, mixing, quality, repeats, secrets, tokens, toxicity
from gleanframe.llm.queries import QUERIES, TOKENIZER
from gleanframe.llm.tables import DOCUMENT_COLUMNS, table

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PAGES = "page_id long, url string, html string"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, size long, id string"
LONG = " ".join(f"word{i % 701} and{i % 13}" for i in range(30_000))
ROWS = [
    (1, "alpha beta gamma delta epsilon zeta eta theta", "en", "b", 1),
    (1, "alpha beta gamma delta epsilon zeta eta theta", "en", "b", 1),
    (2, None, None, None, None),
    (3, "", "en", "a", 0),
    (None, "a null id, token = abcdef0123", None, "a", 2),
    (4, " \n\t ", "en", "a", 3),
    (5, LONG, "en", "c", 4),
    (6, "Ünïcode ẞharp 日本 語 \U0001f600 x", "de", "c", 5),
]


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame([(*r, 0.5, 7, "x") for r in ROWS], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return {r.doc_id: r.text for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()}


def rows_of(frame):
    return {r.doc_id: r for r in frame.collect()}


def test_quality_counts(spark, sf_dir, texts):
    for doc_id, row in rows_of(QUERIES["op2_quality_rules"](spark, sf_dir)).items():
        words = WORD.findall(texts[doc_id])
        windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
        often = collections.Counter(windows)
        covered = {i for k, w in enumerate(windows) if often[w] > 1 for i in range(k, k + 8)}
        lines = [x for x in texts[doc_id].split("\n") if WORD.search(x)]
        assert (row.n_words, row.word_chars) == (len(words), sum(map(len, words)))
        assert row.n_repeat_words == len(covered) and row.n_dup_lines == len(lines) - len(set(lines))
        assert row.base_failed == (len(words) < 20 or 100 * len(covered) > 30 * len(words))


def test_quality_agrees_with_labels(spark, sf_dir):
    found = rows_of(QUERIES["op2_quality_rules"](spark, sf_dir))
    labels = table(spark, sf_dir, "labels").collect()
    clean = [found[r.doc_id] for r in labels if r.quality == 1]
    assert np.mean([r.kept for r in clean if not r.base_failed]) > 0.95


def test_variety_at_any_length(spark):
    rng = np.random.default_rng(23)
    poor, rich = rng.integers(0, 100, 6500), rng.integers(0, 10**6, 6500)
    texts = [" ".join(f"w{x}" for x in ids[:n]) for ids in (poor, rich) for n in (1999, 2000, 2001, 6500)]
    found = rows_of(quality.quality(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    place = list(quality.rules()).index("variety")
    assert [found[i].votes.split(",")[place] for i in range(8)] == ["0"] * 4 + ["-1"] * 4


def test_tokens_round_trip(spark, sf_dir, texts):
    encode, start = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode, 0
    found = rows_of(QUERIES["op3_token_files"](spark, sf_dir))
    for doc_id in sorted(texts):
        ids = np.array([*encode(texts[doc_id], add_special_tokens=False).ids, 0], "<u4")
        row = found[doc_id]
        assert (row.start, row.n_tokens, row.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


@pytest.mark.parametrize("n", [0, 1, 7, 511, 512, 513, 5000])
def test_codes_give_random_access(n):
    ids = (np.random.default_rng(n).random(n) ** 6 * 2**33).astype(np.uint64)
    levels = tokens.pack(ids)
    assert (tokens.unpack(levels) == ids).all()
    assert all(tokens.access(levels, i) == ids[i] for i in range(0, n, 7))


def test_random_access_reads_files(spark, awkward, tmp_path):
    path = str(tmp_path / "tokens")
    tokens.write_tokens(awkward, path, TOKENIZER)
    segments = tokens.read_segments(spark, path)
    ids = Tokenizer.from_file(TOKENIZER).encode(ROWS[4][1], add_special_tokens=False).ids
    # The null id comes first.
    assert tokens.tokens_at(segments, [0, len(ids) - 1, len(ids)]) == {0: ids[0], len(ids) - 1: ids[-1], len(ids): 0}



def test_token_ids_of_random_texts():
    """Pieces have the ids that the tokenizer gives whole texts, wherever these are cut."""
    rng = np.random.default_rng(4)
    parts = [*"abZ don't we're", *"  \n\n\t\r\x0b\x7f\x1c\x00.,!<|>''019éßÑ×÷ÿ", "\x85", "\xa0", "\u2003", "\u3000", "日", "\u0301", "\U0001f600"]
    parts += ["<|endoftext|>", "endoftext|>", "word", " wörd,", "'s", "\n\n"]
    texts = ["".join(rng.choice(parts, int(rng.integers(0, 60)))) for _ in range(4000)]
    texts += ["<|endof", "text|> a<|endoftext|>b", "end of text\n\n", "\n\nA", ""]
    expected = Tokenizer.from_file(TOKENIZER)
    one = tokens.Encoder(TOKENIZER)
    for rows in (texts, texts[::-1]):  # the second time from memory
        ids, first = one.encode(pa.array(rows))
        for k, text in enumerate(rows):
            assert ids[first[k] : first[k + 1]].tolist() == expected.encode(text, add_special_tokens=False).ids, repr(text)


def test_new_pieces_are_encoded_together(monkeypatch):
    """Accents and punctuation don't send pieces through the tokenizer one by one."""
    calls = []
    ids = tokens.Encoder._ids
    monkeypatch.setattr(tokens.Encoder, "_ids", lambda self, text: calls.append(text) or ids(self, text))
    words = [f"{a}é{b}ñ{c}" for a in "abcdefgh" for b in "ijklmn" for c in "opqrst"]
    one = tokens.Encoder(TOKENIZER)
    one.encode(pa.array([" ".join(words), ", ".join(words) + "."]))
    assert len(calls) < 20
    # A word before a comma is the same piece as before a space.
    assert len(one.keys) < 2 * len(words)


def test_secrets(spark, sf_dir, texts):
    for doc_id, row in rows_of(QUERIES["op5_secret_scan"](spark, sf_dir)).items():
        text = texts[doc_id]
        spans = [(m.start(), 0, m.end()) for m in secrets.ASSIGN.finditer(text) if len(m[2]) >= 6]
        spans += [(m.start(), 1, m.end()) for m in secrets.ACCESS.finditer(text) if len(m[0]) >= 20]
        spans += [(m.start(), 2, m.end()) for m in secrets.HEX.finditer(text) if len(m[0]) >= 24]
        joined = ",".join(f"{secrets.BASE_KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))
        assert row.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()


def test_checksums_decide():
    body = "Qz" * 15
    good = f"x ghp_{body}{secrets.base62_crc(body)} y"
    assert [s[2] for s in secrets.scan(good)] == ["checked"]
    assert not secrets.scan(good.replace("ghp_Q", "ghp_R"))
    assert secrets.scan("İ token=token=abcdef")[0][:2] == (2, 20)


def test_key_blocks_as_one_pattern():
    """As one lazy regular expression finds them, also where lines nest, overlap or lack an end."""
    whole = re.compile(r"-----BEGIN ([A-Z ]*PRIVATE KEY)-----[A-Za-z0-9+/=\s:,-]*?-----END \1-----", re.ASCII)
    parts = [f"-----{w} {k}PRIVATE KEY-----" for w in ("BEGIN", "END") for k in ("", "RSA ")] + ["-", "-----", "aB+/=\n", " ", ".", "é", "-----END "]
    rng = np.random.default_rng(5)
    for _ in range(20_000):
        text = "".join(parts[i] for i in rng.choice(len(parts), int(rng.integers(1, 14)), p=[0.2, 0.1, 0.2, 0.1] + [0.4 / 7] * 7))
        expected = [(m.start(), m.end(), "key_block") for m in whole.finditer(text)]
        assert [s for s in secrets.scan(text) if s[2] == "key_block"] == expected, text


def test_key_headers_without_end_take_linear_time():
    times = []
    for n in (2_000, 32_000):
        begin = time.perf_counter()
        assert not secrets.scan("-----BEGIN PRIVATE KEY-----\nabc\n" * n)
        times.append(time.perf_counter() - begin)
    assert times[1] < 64 * times[0]


def test_punctuation_of_any_length_is_trimmed(spark):
    item = " ".join(f"w{i}" for i in range(30))
    text = " ".join(f"{'(' * i}w{i}{'.' * i}" for i in range(30)) + " ..... ......"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    found = decontaminate.leaks(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
    assert [(r.item_id, r.score) for r in found] == [(7, 1.0)]


def test_main_text(spark, sf_dir):
    expected = {}
    for row in table(spark, sf_dir, "pages").collect():
        inside = re.search(r"<article>(.*?)(?:</article>|<footer|\Z)", row.html, re.S)[1].replace("<br>", " ")
        blocks = [re.sub(r"<[^>]*>?", "", b) for b in re.split(r"</?(?:p|h1)>", inside)]
        expected[row.page_id] = " ".join(filter(None, (" ".join(entities.unescape(b).split()) for b in blocks)))
    found = {r.page_id: r.text for r in QUERIES["op6_main_text"](spark, sf_dir).collect()}
    assert found == expected


def test_template_texts_go(spark):
    page = "<body><div class='top'>Daily &amp; News</div><div><p>{}</p></div><div class='comments'>hi</div></body>"
    rows = [(i, "http://h.example/a", page.format(f"story {i}"), 1) for i in range(4)] + [(9, None, None, 1)]
    found = html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, key long"))
    assert {r.page_id: r.text for r in found.collect()} == {**{i: f"story {i}" for i in range(4)}, 9: ""}


def test_template_texts_inside_articles_go(spark):
    page = (
        "<html><body><p>Top</p><article><h1>Title {0}</h1><p>Story {0}</p><p>Share this</p><div>Advert: buy</div>"
        "<ul><li>Follow us</li></ul></article></body></html>"
    )
    rows = [(i, "http://h.example/a", page.format(i)) for i in range(5)]
    rows.append((5, "http://h.example/a", re.sub("<h1>.*Story 0</p>", "", page.format(0))))
    # Copies of one article say nothing about a template, and neither do two pages.
    copy = "<html><head><title>{}</title></head><body><article><h1>One</h1><p>Same</p></article></body></html>"
    rows += [(10 + i, "http://copies.example/", copy.format(i)) for i in range(4)]
    rows += [(20 + i, "http://few.example/", page.format(i)) for i in range(2)]
    found = html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string"))
    expected = {i: f"Title {i} Story {i}" for i in range(5)} | {5: ""} | {10 + i: "One Same" for i in range(4)}
    expected |= {20 + i: f"Title {i} Story {i} Share this Advert: buy Follow us" for i in range(2)}
    assert {r.page_id: r.text for r in found.collect()} == expected


def test_class_names_inside_articles(spark):
    """Whole names count, names of an article's own parts only where the links agree."""
    blocks = {
        "<section class='related-work'>Prior art</section>": "Prior art",
        "<p class='notice-period'>Three months</p>": "Three months",
        "<div id='comment-on-kant'>On Kant</div>": "On Kant",
        "<section class='discussion'>We discuss <a href='x'>it</a> at length</section>": "We discuss it at length",
        "<div title='a hidden truth' data-id='ad'>Plain</div>": "Plain",
        "<div class='related'><a href='x'>One</a> <a href='y'>Two</a></div>": "",
        "<div class='comment-list'><p>First!</p></div>": "",
        "<div class='cookie-notice'>We bake</div>": "",
        "<div hidden>Unseen</div>": "",
    }
    rows = [(i, f"http://h{i}.example/", f"<body><article>{b}</article></body>") for i, b in enumerate(blocks)]
    rows.append((99, "http://other.example/", "<body><div class='related-work'>x</div><div>y</div></body>"))
    found = {r.page_id: r.text for r in html.main_text(spark.createDataFrame(rows, PAGES)).collect()}
    assert found == {**dict(enumerate(blocks.values())), 99: "y"}


def test_pages_on_awkward_rows(spark):
    """Repeated rows, nulls, clashing columns, a long and a deep page, an empty table."""
    page = "<body><div>Top</div><article><p>Story {}</p></article><div>End</div></body>"
    long = "<body><article>" + "".join(f"<p>part {i}</p>" for i in range(50_000)) + "</article></body>"
    deep = "<div>" * 20_000 + "end"
    rows = [(1, "http://h/", page.format(1))] * 3 + [(None, None, page.format(2)), (2, "http://h/", None), (3, None, "")]
    rows += [(4, "http://h/", long), (5, "http://h/", deep), (6, "x" * 9000, "<<p a=\"'>& &amp; &#0;\ud83d\ude00".encode("utf-16", "surrogatepass").decode("utf-16"))]
    schema = PAGES + ", key long, row string, class string, token long, blocks string"
    frame = spark.createDataFrame([(*r, 1, "a", "b", 2, "c") for r in rows], schema)
    found = html.main_text(frame.repartition(3)).collect()
    texts = collections.Counter((r.page_id, r.text) for r in found if r.page_id not in (4, 6))
    assert texts == {(1, "Story 1"): 3, (None, "Story 2"): 1, (2, ""): 1, (3, ""): 1, (5, "end"): 1}
    assert [r.n_chars for r in found if r.page_id == 4] == [sum(len(f"part {i} ") for i in range(50_000)) - 1]
    assert len(found) == len(rows) and html.main_text(frame.limit(0)).collect() == []


def test_repeated_pages_count_once(spark):
    """Two different pages are no template, however often their rows are repeated."""
    page = "<body><article><h1>Title {0}</h1><p>Shared line</p></article></body>"
    rows = [(i, "http://h/", page.format(i % 2)) for i in range(8)]
    found = html.main_text(spark.createDataFrame(rows, PAGES)).collect()
    assert {r.page_id: r.text for r in found} == {i: f"Title {i % 2} Shared line" for i in range(8)}


def test_toxicity_on_held_out_labels(spark):
    """A fifth of the labels, told by their ids, is kept from the fit."""
    sf_dir = "/root/testdata/sf0.1"
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = "crc32(cast(doc_id as string)) % 5 = 1"
    known = {r.doc_id: r.toxic for r in labels.where(held).collect()}
    model = toxicity.train(docs, labels.where(f"not ({held})"))
    rows = toxicity.severity(docs.where(held), model).where("doc_id is not null").collect()
    grade = np.array([known[r.doc_id] for r in rows if r.doc_id in known])
    score = np.array([r.severity for r in rows if r.doc_id in known])
    said = np.array([r.toxic for r in rows if r.doc_id in known])
    above = (score[grade == 1][:, None] > score[grade == 0]).mean()
    assert above > 0.95 and said[grade == 1].mean() > 0.9 and said[grade == 0].mean() < 0.06
    assert ((0 <= score) & (score <= 2)).all() and len(model.thresholds) == 2 and (np.diff(model.thresholds) > 0).all()


def test_toxicity_without_both_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    for rows in ([], [(1, 1)], [(1, None), (2, 0)]):
        model = toxicity.train(docs, spark.createDataFrame(rows, "doc_id long, toxic int"))
        assert not any(r.toxic for r in toxicity.severity(docs, model).collect())


def test_unigram_base_and_model(spark, sf_dir, texts):
    counts, found = collections.Counter(), rows_of(QUERIES["op8_context_tree"](spark, sf_dir))
    as_tokens = {i: [*t.encode().lower().split(), b"\n"] for i, t in texts.items()}
    for i, words in as_tokens.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update(words)
    total, distinct = sum(counts.values()), len(counts)
    for i, words in as_tokens.items():
        base = sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in words)
        row = found[i]
        assert (row.n_tokens, row.n_known) == (len(words), sum(counts[w] > 0 for w in words))
        assert row.base_score == pytest.approx(base) and row.train_tokens == total
        assert row.held_out == (zlib.crc32(str(i).encode()) % 7 == 2) and row.score < 0


def test_scores_alike_broadcast_or_joined(spark, sf_dir, monkeypatch):
    docs = table(spark, sf_dir, "documents").limit(40).localCheckpoint()
    small = {i: r.score for i, r in rows_of(lm.lm_scores(docs)).items()}
    monkeypatch.setattr(lm, "BROADCAST_GRAMS", 0)
    joined = {i: r.score for i, r in rows_of(lm.lm_scores(docs)).items()}
    assert small == pytest.approx(joined, rel=1e-12)


def test_context_tree_sums_to_one(spark):
    data = np.random.default_rng(5).integers(97, 101, 400).astype(np.uint8)
    stream = np.concatenate([np.full(lm.DEPTH, 10, np.uint8), data])
    keys = [sum(int(stream[i + k]) << 8 * (lm.DEPTH - k) for k in range(lm.DEPTH + 1)) for i in range(len(data))]
    counts = collections.Counter(keys)
    context = keys[200] & ~0xFF
    every = {context | b: counts.get(context | b, 0) for b in range(256)} | counts
    frame = spark.createDataFrame([(lm.GRAM, k, n) for k, n in every.items()], "kind int, key long, n long")
    found = {r.key: r.log10 for r in lm.gram_scores(frame).collect()}
    assert sum(10 ** found[context | b] for b in range(256)) == pytest.approx(1)


def brute_classes(texts, size, num, den):
    sets = {}
    for i, t in texts.items():
        w = t.encode().lower().split()
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} or ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        common = len(sets[a] & sets[b])
        if common and den * common >= num * (len(sets[a]) + len(sets[b]) - common):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in sets}


@pytest.mark.parametrize("size,num,den,rounds", [(3, 90, 100, 0), (5, 80, 100, 0), (5, 80, 100, 2)])
def test_jaccard_classes(spark, texts, size, num, den, rounds):
    base = [f"w{i}" for i in range(60)]
    more = dict(texts) | {
        10_000 + k: " ".join(f"x{k}" if i in (k, k * 7 % 60) else w for i, w in enumerate(base)) for k in range(40)
    }
    # A group whose members lie all around the threshold from each other.
    rng = np.random.default_rng(7)
    for k in range(60):
        edits = set(rng.choice(200, int(rng.integers(1, 5)), replace=False).tolist())
        more[30_000 + k] = " ".join(f"y{k}" if i in edits else f"g{i}" for i in range(200))
    more |= {20_000: " ".join(base), 20_001: "one two", 20_002: "ONE two", 20_003: ""}
    docs = spark.createDataFrame(list(more.items()), "doc_id long, text string").repartition(4)
    found = jaccard.jaccard_classes(docs, jaccard.Join(size, num, den, rounds)).collect()
    assert {r.doc_id: (r.n, r.component_id) for r in found} == brute_classes(more, size, num, den)


def test_token_pairs_by_runs(spark):
    """Runs give every pair the number of common tokens that one row per token gives, in few rows."""
    rng = np.random.default_rng(8)
    whole = np.sort(rng.choice(10_000, 240, replace=False))
    sets = [np.delete(whole, rng.choice(240, int(rng.integers(0, 40)), replace=False)) for _ in range(30)]
    rows = []
    for name, items in enumerate(sets, 100_000):
        used = items[: len(items) * 2 // 3]
        row, ids, lost = np.zeros(len(used), int), np.full(len(used), name), np.cumsum(rng.integers(0, 2, len(used)))
        level = np.maximum(1, np.arange(len(used)) - 100)
        more = jaccard.beside(used, row, ids, lost, level)
        ell = int(rng.integers(1, 40))
        use = level <= ell
        columns = [used, ids, lost, level, np.full(len(used), ell), *more.values()]
        rows += [tuple(map(int, r)) for r, u in zip(zip(*columns), use) if u]
    frame = spark.createDataFrame(rows, "token long, id long, lost long, level long, ell long" + jaccard.BESIDE_SCHEMA)
    possible = lambda a, b, lost="lost": F.greatest(f"{a}.{lost}", f"{b}.{lost}") < 45
    made = {}
    for runs in (False, True):
        pairs = links.token_pairs(frame, frame, F.col("o.id") < F.col("x.id"), possible, True, runs)
        made[runs] = pairs.count(), {(r.a, r.b): r.n for r in pairs.groupBy("a", "b").agg(F.sum("k").alias("n")).collect()}
    assert made[True][1] == made[False][1] and len(made[True][1]) > 400
    assert made[True][0] < made[False][0] / 2


def test_hubs_that_link_nothing_end_the_rounds(spark, monkeypatch):
    """Sets that share tokens without being linked meet further hubs once, not in every round."""
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(400)]
    docs = [(i, " ".join(w if rng.random() > 0.08 else f"x{i}{k}" for k, w in enumerate(words))) for i in range(12)]
    rounds = []
    more = links._more_hubs
    monkeypatch.setattr(links, "_more_hubs", lambda rows, number: rounds.append(number) or more(rows, number))
    found = jaccard.jaccard_classes(spark.createDataFrame(docs, "doc_id long, text string"), jaccard.Join(words=3, num=70, den=100, rounds=4))
    assert found.select("component").distinct().count() == len(docs) and len(rounds) == 1



def test_repeated_passages(spark):
    rng = np.random.default_rng(3)
    fresh = lambda n: " ".join(f"v{x}" for x in rng.integers(0, 10**9, n))
    passage = fresh(60)
    docs = [(i, f"{fresh(80)} {passage} {fresh(40)}" if i < 5 else fresh(150)) for i in range(20)]
    found = repeats.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id for r in found} == set(range(5))
    assert {r.doc_id for r in found if not r.removed} == {0}
    assert all(r.start < docs[r.doc_id][1].index(passage) + len(passage) and 0 in r.first_docs for r in found)


def test_leaks(spark):
    item = " ".join(f"q{i}" for i in range(40))
    edited = " ".join("zz" if i % 9 == 4 else w for i, w in enumerate(item.upper().split()))
    docs = [(1, f"before {item} after"), (2, f"x y z {edited} end"), (3, "nothing of that kind"), (4, None)]
    items = spark.createDataFrame([(7, item), (8, None)], "item_id long, text string")
    found = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(1, 7), (2, 7)}
    exact = next(r for r in found if r.doc_id == 1)
    assert docs[0][1][exact.start : exact.end] == item and exact.score == 1


def passages_found(spark, docs):
    rows = repeats.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    found = collections.defaultdict(list)
    for r in rows:
        found[r.doc_id].append((r.start, r.end))
    return found


def test_repeats_just_over_fifty_words(spark):
    rng = np.random.default_rng(17)
    fresh = lambda n: " ".join(f"v{x}" for x in rng.integers(0, 10**9, n))
    passages = [fresh(51) for _ in range(300)]
    docs = [(2 * i + k, f"{fresh(60)} {p} {fresh(60)}") for i, p in enumerate(passages) for k in range(2)]
    found = passages_found(spark, docs)
    spans = {d: (at, at + len(passages[d // 2])) for d, text in docs for at in [text.index(passages[d // 2])]}
    assert len(found) >= 0.99 * len(docs) and all(len(x) == 1 for x in found.values())
    # An outermost paragraph linked by similarity only may differ by a few words (of at most 10 letters).
    assert np.mean([found[d] == [spans[d]] for d in found]) > 0.9
    assert all(abs(x - y) < 66 for d in found for x, y in zip(found[d][0], spans[d]))


def test_near_repeats_of_whole_passages(spark):
    rng = np.random.default_rng(19)
    fresh = lambda n: [f"v{x}" for x in rng.integers(0, 10**9, n)]
    docs = []
    for i in range(300):
        passage = fresh(int(rng.integers(60, 101)))
        edited = list(passage)
        for at in rng.choice(len(passage), 1 + (len(passage) >= 95) * (i % 2), replace=False):
            edited[at] = "zz"
        docs += [(2 * i + k, " ".join([*fresh(60), *p, *fresh(60)])) for k, p in enumerate((passage, edited))]
    found = passages_found(spark, docs)
    assert len(found) >= 0.99 * len(docs)


def brute_alignment(item, text):
    """Share of the item's perfect Smith-Waterman score, cell by cell."""
    best, row = 0, [0] * (len(text) + 1)
    for word in item:
        new = [0]
        for j, other in enumerate(text):
            new.append(max(0, row[j] + (2 if word == other else -1), row[j + 1] - 1, new[j] - 1))
        row, best = new, max(best, *new)
    return best / (2 * len(item))


def test_leaks_with_random_edits(spark):
    rng = np.random.default_rng(11)
    fresh = lambda n: [f"v{x}" for x in rng.integers(0, 10**9, n)]
    items = {i: fresh(int(rng.integers(15, 61))) for i in range(60)}
    docs = {1000 + i: [*fresh(30), *item, *fresh(30)] for i, item in items.items() if i % 2}
    for i, item in items.items():
        for k, rate in enumerate((0.1, 0.15, 0.2, 0.25)):
            kinds = rng.random(len(item)) / rate
            edited = [x for w, u in zip(item, kinds) for x in ([w] if u > 1 else fresh(1) if u > 0.4 else [w, *fresh(1)] if u > 0.2 else [])]
            docs[10 * i + k] = [*fresh(40), *edited, *fresh(40)]
        # The same edit in many documents: every fifth word.
        edited = ["zz" if n % 5 == 3 else w for n, w in enumerate(item)]
        docs |= {5000 + 10 * i + k: [*fresh(20), *edited, *fresh(20)] for k in range(2)}
    table_ = lambda rows, name: spark.createDataFrame([(i, " ".join(w)) for i, w in rows.items()], f"{name} long, text string")
    found = decontaminate.leaks(table_(docs, "doc_id"), table_(items, "item_id")).collect()
    of = lambda d: d - 1000 if 1000 <= d < 2000 else (d - 5000 if d >= 5000 else d) // 10
    expected = {(d, of(d)): score for d, text in docs.items() if (score := brute_alignment(items[of(d)], text)) >= 0.5}
    assert {(r.doc_id, r.item_id): r.score for r in found} == pytest.approx(expected)


def test_mix_meets_targets(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = mixing.mixed(docs).collect()
    again = mixing.mixed(docs.repartition(5)).collect()
    assert sorted((r.doc_id, r.taken) for r in rows) == sorted((r.doc_id, r.taken) for r in again)
    by = collections.defaultdict(int)
    for r in rows:
        by[r.source, r.target] += r.taken
        assert r.taken <= 2 * r.size
    longest = max(r.size for r in rows)
    assert all(abs(taken - target) <= 2 * longest for (_, target), taken in by.items())


OPERATORS = {
    "quality": lambda spark, d, sf: quality.quality(d),
    "tokens": lambda spark, d, sf: tokens.token_table(d, TOKENIZER),
    "leaks": lambda spark, d, sf: decontaminate.leaks(d, table(spark, sf, "benchmark")),
    "secrets": lambda spark, d, sf: secrets.secret_spans(d),
    "toxicity": lambda spark, d, sf: toxicity.severity(d, toxicity.train(d, table(spark, sf, "labels"))),
    "lm": lambda spark, d, sf: lm.lm_scores(d),
    "jaccard": lambda spark, d, sf: jaccard.jaccard_classes(d),
    "repeats": lambda spark, d, sf: repeats.repeated_passages(d),
    "mixing": lambda spark, d, sf: mixing.mixed(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_awkward_rows(spark, awkward, empty, sf_dir, name):
    rows = OPERATORS[name](spark, awkward, sf_dir).collect()
    assert len(rows) == (0 if name in ("leaks", "repeats") else len(ROWS))
    assert OPERATORS[name](spark, empty, sf_dir).collect() == []


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stage_on_awkward_rows(spark, awkward, empty, sf_dir, name, stage):
    found = stage(spark, awkward, sf_dir)
    if name != "token_files":
        assert tuple(found.columns) == DOCUMENT_COLUMNS
    kept = found.collect()
    if name == "jaccard_join":
        assert sorted(r.doc_id or 0 for r in kept) == [0, 1, 2, 3, 4, 5, 6]
    if name in ("toxicity", "decontamination"):
        assert len(kept) == len(ROWS)
    assert stage(spark, empty, sf_dir).collect() == []
