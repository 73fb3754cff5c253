"""The operators against brute force, libraries and exact round trips, and in every odd case."""

import hashlib
import os
import random
import re
import struct
import zlib
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from csift.llm import bpe, chat, exact_dedup, html_text, licenses, media, mixing, png, quality, simhash, toxicity
from csift.llm.components import stars
from csift.llm.vptree import VantageTree, linked_groups

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 977}" for i in range(30_000))


def documents(spark, texts, sources=None, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    sources = sources or ["s"] * len(texts)
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in zip(ids, texts, sources)], SCHEMA).repartition(3)


def odd(spark):
    """Nulls everywhere, empty and long texts, ties, repeated rows, and columns with clashing names."""
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (None, "x y z", "en", "a", 5), (None, None, None, None, None), (3, "same text here", "en", "b", 14), (3, "same text here", "en", "b", 14)]
    rows += [(4, "same text here", "en", "b", 14), (5, LONG, "en", "a", len(LONG)), (6, " \n\t ", "en", "a", 4), (7, "\x00é漢🙂", "en", "c", 4)]
    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("size", "target", "kept", "fingerprint", "media", "score", "hash", "count", "_row")})


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


# exact dedup
def test_exact_copies(spark):
    chance = random.Random(1)
    texts = ["hot"] * 300 + [f"t{chance.randint(0, 80)}" for _ in range(200)] + [None, ""]
    rows = exact_dedup.exact_copies(documents(spark, texts)).collect()
    groups = {}
    for i, t in enumerate(texts):
        groups.setdefault(t or "", []).append(i)
    assert len(rows) == len(texts)
    for r in rows:
        own = groups[texts[r["doc_id"]] or ""]
        assert (r["keep_id"], r["group_size"], r["kept"]) == (max(own), len(own), r["doc_id"] == max(own))
        assert r["text_sha256"] == hashlib.sha256((texts[r["doc_id"]] or "").encode()).hexdigest()


def test_heavy_hitters_are_split_off(spark):
    digests = documents(spark, ["hot"] * 200 + [f"t{i}" for i in range(300)]).select("doc_id", exact_dedup.digest_column().alias("_csift_digest"), F.lit(0).alias("_csift_row"))
    found = exact_dedup.verified_winners(digests, heavy=3, counters=32).collect()
    assert [(r["_csift_n"], r["_csift_best"]["doc_id"]) for r in found] == [(200, 199)]


def test_exact_odd(spark, nothing):
    rows = exact_dedup.exact_copies(odd(spark)).collect()
    same = [r for r in rows if r["group_size"] == 3 and r["keep_id"] == 4]
    assert sum(r["kept"] for r in rows) == len({r["text_sha256"] for r in rows}) and len(same) == 3
    kept = exact_dedup.drop_copies(odd(spark))
    assert kept.columns == odd(spark).columns and kept.count() == len({r["text_sha256"] for r in rows})
    assert exact_dedup.exact_copies(nothing).count() == exact_dedup.drop_copies(nothing).count() == 0


def test_repeated_rows_leave_one(spark):
    docs = documents(spark, ["a"] * 40 + ["b", "b"], ids=[7] * 40 + [8, 8])
    assert sorted(r["doc_id"] for r in exact_dedup.drop_copies(docs).collect()) in ([7, 8], [7] * 40 + [8])
    assert sum(r["kept"] for r in exact_dedup.exact_copies(docs).collect()) == 2


# mixing
def filled(sizes, weights=(5, 2, 1), share=1.5, limit=2.0):
    """Targets by resharing the excess round after round."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    total, target, free = share * sum(sizes.values()), {}, set(order)
    while free:
        left = total - sum(target.values())
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > limit * sizes[s] + 1e-9}
        if not over:
            return target | {s: weight[s] * level for s in free}
        target |= {s: limit * sizes[s] for s in over}
        free -= over
    return target


def test_mixture(spark):
    chance = random.Random(2)
    sources = [chance.choice(["a", "b", "b", "b", "c", "d", None]) for _ in range(3000)]
    texts = ["w " * chance.randint(0, 30) for _ in sources]
    docs = documents(spark, texts, sources)
    rows = mixing.mixture(docs).collect()
    sizes = {}
    for s, t in zip(sources, texts):
        sizes[s] = sizes.get(s, 0) + len(t.split())
    wanted = filled(sizes)
    taken = {}
    for r in rows:
        assert r["size"] == len(texts[r["doc_id"]].split()) and r["taken"] <= 2 * r["size"] and r["taken"] % max(r["size"], 1) == 0
        assert r["target"] == pytest.approx(wanted[r["source"]]) and r["source_size"] == sizes[r["source"]]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    for s in sizes:
        assert taken[s] == pytest.approx(wanted[s], rel=0.005)
    assert sum(wanted.values()) == pytest.approx(1.5 * sum(sizes.values()))
    again = {r["doc_id"]: r["taken"] for r in mixing.mixture(docs.repartition(5)).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in rows}
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert {r["doc_id"]: r["n"] for r in mixed.groupBy("doc_id").agg(F.count("*").alias("n")).collect()} == {r["doc_id"]: r["copies"] for r in rows if r["copies"]}


def test_sources_of_few_documents_come_near_their_targets(spark):
    chance = random.Random(12)
    sources = [f"s{k:02d}" for k in range(30) for _ in range(12)]
    texts = ["w " * chance.randint(5, 60) for _ in sources]
    rows = mixing.mixture(documents(spark, texts, sources)).collect()
    taken, wanted = {}, {}
    for r in rows:
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        wanted[r["source"]] = r["target"]
        assert r["copies"] - r["rate"] < 1 and r["rate"] - r["copies"] < 1
    assert all(taken[s] == pytest.approx(wanted[s], rel=0.05) for s in wanted)


def test_many_sources_take_the_salted_way(spark):
    docs = documents(spark, ["a b c"] * 40, [f"s{i % 5}" for i in range(40)])
    table = mixing.rates(docs.select("source", mixing.size_column().alias("size")))
    one = mixing.with_rates(docs, table).select("doc_id", "_csift_rate").collect()
    many = mixing.with_rates(docs, table, broadcast_sources=2, salts=4).select("doc_id", "_csift_rate").collect()
    assert sorted(one) == sorted(many)


def test_mixing_odd(spark, nothing):
    rows = mixing.mixture(odd(spark)).collect()
    assert len(rows) == 10 and all(r["target"] <= 2 * r["source_size"] + 1e-9 for r in rows)
    assert mixing.mix(odd(spark)).columns == odd(spark).columns
    assert mixing.mixture(nothing).count() == mixing.mix(nothing).count() == 0


# chat
TURNS = "conv_id long, turn long, role string, text string"


def turns_of(spark, conversations):
    return spark.createDataFrame([(c, i, r, t) for c, turns in conversations.items() for i, (r, t) in enumerate(turns)], TURNS).repartition(3)


def test_chat_round_trip(spark):
    chance = random.Random(3)
    parts = ["</s>", "[INST]", "[/INST]", "<s>", "\\", "\\o", "\\b", "<<SYS>>", "[", "<", "a b", "\n", "é", ""]
    text = lambda: "".join(chance.choice(parts) for _ in range(chance.randint(0, 8)))
    conversations = {c: [(chance.choice(["system", "user", "assistant", "tool\n[INST]"]), text()) for _ in range(chance.randint(1, 25))] for c in range(30)}
    conversations[99] = [("system", "be kind")] + [("user" if i % 2 else "assistant", f"turn {i} " * 9) for i in range(60)]
    windows = chat.chat_windows(turns_of(spark, conversations), budget=100, history_turns=2, history_tokens=45)
    for r in chat.conversation_digests(windows).collect():
        turns = conversations[r["conv_id"]]
        loss = "".join(t for role, t in turns if role == "assistant")
        assert r["n_turns"] == len(turns) and r["loss_chars"] == len(loss)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    rows = sorted(windows.filter("conv_id = 99").collect(), key=lambda r: r["window"])
    assert len(rows) > 3
    for k, r in enumerate(rows):
        assert r["formatted"].startswith("<s>[INST]system[/INST]be kind</s>")
        assert r["n_repeated"] == {0: 0, 1: 2}.get(k, 3) and r["formatted"].count("</s>") > r["n_repeated"] and r["n_tokens"] <= 100
    again = [rows[k]["formatted"].split("</s>")[:-1][-2:] == rows[k + 1]["formatted"].split("</s>")[1:3] for k in range(1, len(rows) - 1)]
    assert all(again)


def greedy(sizes, system, budget, history_turns, history_tokens):
    """Windows of a conversation by one pass: (first, last, repeated, tokens); sizes are the turns' tokens."""
    room, spans = max(1, budget - history_tokens - system), []
    before, stretch = 0, 0
    for k, n in enumerate(sizes):
        here = before // (room * chat.BLOCKS)
        if not spans or here != stretch or sum(sizes[spans[-1][0] : k]) + n > room:
            spans.append([k, k])
        spans[-1][1] = k
        before, stretch = before + n, here
    out = []
    for w, (first, last) in enumerate(spans):
        own, told, again = sum(sizes[first : last + 1]), 0, 0
        for k in range(first - 1, max(-1, first - 1 - history_turns), -1):
            told += sizes[k]
            if (k or not system) and told <= history_tokens and told + system + own <= budget:
                again += 1
        out.append((again + bool(w and system), own + (system if w else 0) + sum(sizes[first - again : first])))
    return out


def test_every_window_keeps_the_budget(spark):
    chance, budget, turns, tokens = random.Random(13), 120, 2, 30
    texts = {c: [("system" if k == 0 and c % 2 else chance.choice(["user", "assistant"]), "w " * chance.choice([0, 1, 5, 20, 40, 70, 110])) for k in range(chance.choice([1, 3, 40, 400]))] for c in range(16)}
    for c, said in texts.items():
        if c % 2:
            said[0] = ("system", "w " * chance.choice([2, 10, 30]))
    rows = chat.chat_windows(turns_of(spark, texts), budget, turns, tokens).collect()
    for c, said in texts.items():
        sizes = [len(t.split()) + chat.MARKS for _, t in said]
        system = sizes[0] if c % 2 else 0
        mine = [(r["n_repeated"], r["n_tokens"]) for r in sorted((r for r in rows if r["conv_id"] == c), key=lambda r: r["window"])]
        assert mine == greedy(sizes, system, budget, turns, tokens)
        for (_, n), r in zip(mine, sorted((r for r in rows if r["conv_id"] == c), key=lambda r: r["window"])):
            own = r["formatted"].count("</s>") - r["n_repeated"]
            assert n <= budget or own == 1 and r["n_repeated"] <= 1  # the system turn and a single turn
    assert sum(r["n_tokens"] > budget for r in rows) < len(rows) / 10
    assert max(len([r for r in rows if r["conv_id"] == c]) for c in texts) > chat.BLOCKS


def test_a_turn_beyond_the_budget_is_whole(spark):
    windows = chat.chat_windows(turns_of(spark, {1: [("user", "a " * 50), ("assistant", "b " * 500), ("user", "c")]}), budget=60, history_turns=1, history_tokens=10).collect()
    assert any("b " * 500 in r["formatted"] for r in windows)


def test_the_query_makes_several_windows(spark):
    from csift.llm import queries

    folder = "/root/testdata/sf0.01"
    if not os.path.isdir(folder):
        pytest.skip("no tables here")
    turns = spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text")
    counts = chat.chat_windows(turns, queries.CHAT_BUDGET, history_tokens=queries.CHAT_HISTORY).groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.sum("n_repeated").alias("repeated")).collect()
    assert sum(r["n"] > 1 for r in counts) > len(counts) / 2 and sum(r["repeated"] > 0 for r in counts) > len(counts) / 3


def test_chat_odd(spark):
    rows = [(None, 0, None, None), (None, 0, "user", "b"), (None, 0, "user", "b"), (1, None, "user", "a"), (1, 0, "assistant", None), (1, 0, "assistant", None), (2, 0, "assistant", LONG)]
    rows = spark.createDataFrame(rows, TURNS).withColumns({c: F.lit(1) for c in ("window", "place", "tokens", "members")})
    out = chat.conversation_digests(chat.chat_windows(rows)).collect()
    found = {r["conv_id"]: r for r in out}
    assert sorted(r["n_turns"] for r in out if r["conv_id"] is None) == [1, 2]  # rows of no conversation aren't one
    assert found[1]["n_turns"] == 3 and found[2]["loss_chars"] == len(LONG)
    empty = spark.createDataFrame([], TURNS)
    assert chat.conversation_digests(chat.chat_windows(empty)).count() == 0


# media
def test_png_filters_and_checksums():
    chance = np.random.default_rng(4)
    samples = chance.integers(0, 256, (37, 64), dtype=np.uint8)
    for kind in range(5):
        assert (png.read(png.write(samples, (kind,))) == samples).all()
    rows, kinds = np.empty((40, 64), np.uint8), chance.integers(0, 5, 40).astype(np.uint8)
    image = chance.integers(0, 256, (40, 64), dtype=np.uint8)
    for y in range(40):
        rows[y] = png.filtered(image[: y + 1], kinds[y])[y]
    assert (png.unfiltered(rows, kinds) == image).all()
    data = png.write(samples)
    for at in (3, 20, 60, len(data) - 6):
        broken = bytearray(data)
        broken[at] ^= 1
        with pytest.raises(png.BadImage):
            png.read(bytes(broken))
    with pytest.raises(png.BadImage):
        png.read(data[:-5])


def by_hand(data):
    """Samples of a PNG, read without the module."""
    at, stream = 8, b""
    while at < len(data):
        (n,) = struct.unpack_from(">I", data, at)
        if data[at + 4 : at + 8] == b"IDAT":
            stream += data[at + 8 : at + 8 + n]
        at += n + 12
    raw, out, above = zlib.decompress(stream), b"", bytes(64)
    for y in range(0, len(raw), 65):
        row = bytes((x + (above[i] if raw[y] == 2 else 0)) & 255 for i, x in enumerate(raw[y + 1 : y + 65]))
        out, above = out + row, row
    return out


def test_media(spark, nothing):
    docs = odd(spark).filter("doc_id <> 5 or doc_id is null")
    texts = [r["text"] or "" for r in docs.collect()]
    stored = media.store_texts(docs).collect()
    payloads = sorted(t.encode() + bytes(-len(t.encode()) % 64 or (0 if t else 64)) for t in texts)
    assert sorted(by_hand(bytes(r["media"])) for r in stored) == payloads
    rows = media.media_columns(docs).collect()
    assert sorted(r["payload_sha256"] for r in rows) == sorted(hashlib.sha256(p).hexdigest() for p in payloads)
    assert sorted(r["tail_crc32"] for r in rows) == sorted(zlib.crc32(p[-64:]) for p in payloads)
    assert len({r["feature"] for r in rows if r["payload_bytes"] == 64 and r["n_bytes"] == 14}) == 1
    assert media.media_columns(nothing).count() == 0


def test_hash_is_of_low_frequencies():
    y, x = np.mgrid[0:320, 0:64]
    smooth = (128 + 60 * np.cos(x / 20) + 60 * np.sin(y / 90)).astype(np.uint8)
    noisy = np.clip(smooth + np.random.default_rng(5).integers(-3, 4, smooth.shape), 0, 255).astype(np.uint8)
    bits = lambda a: np.unpackbits(np.frombuffer(media.cosine_hash(a), np.uint8))
    assert (bits(smooth) != bits(noisy)).sum() < (bits(smooth) != bits(255 - smooth)).sum()


# html
PAGE = '<html><head><title>t</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/">Home</a></ul></nav><div class="ad">Buy</div>{inside}<div class="promo-box">Join {n}</div><section>Shared line</section><footer>&copy; x</footer></body></html>'


def test_main_text(spark):
    article = "<article><h1>A  title</h1><p><b>One &amp; two.<br><p>Three\n four&nbsp;five</p><aside>no</aside><ul><li>six<li>seven</ul><form>no</form><div class='comments'>no</div><p>Is.</p></article>"
    assert html_text.main_text(PAGE.replace("{inside}", article)) == "A title\nOne & two.\nThree four five\nsix\nseven\nIs."
    assert html_text.main_text("") == "" and html_text.main_text("a < b") == "a < b"
    assert html_text.main_text("<p>x<p>y<script>z") == "x\ny"
    assert html_text.main_text("<main><p>in</p></main><p>out</p>") == "in"


def test_templates_are_removed(spark, nothing):
    rows = []
    for n in range(12):
        rows.append((n, f"https://a.example/{n}", PAGE.replace("{inside}", f"<div><p>Body {n} of the page.</p></div><div><span>Always here</span></div>").replace("{n}", str(n))))
        rows.append((100 + n, f"http://b.example/{n}", f"<body><article><p>Is.</p><p>Text {n}</p></article></body>"))
    rows += [(200, None, None), (201, "odd url", "<p>x</p>"), (201, "odd url", "<p>x</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).repartition(4)
    for limit in (10_000, 0):  # broadcast, and the join
        found = {r["page_id"]: r["text"] for r in html_text.extract(pages, broadcast=limit).collect()}
        assert found[3] == "Body 3 of the page."  # the shared section and the div that always stands there are gone
        assert found[105] == "Is.\nText 5"  # a short paragraph that recurs in articles stays
        assert found[200] == "" and found[201] == "x"
    assert html_text.extract(pages).count() == len(rows)
    assert html_text.extract(pages.filter("false")).count() == 0


class ArticleReader(HTMLParser):
    """The text of a page's article, by the library's parser: blocks end at tags of blocks, and other parts are left out."""

    BLOCKS, OTHERS = frozenset("article h1 h2 p br div ul li".split()), frozenset("script style nav aside form footer".split())

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.inside, self.left_out, self.held, self.blocks = 0, 0, [], []
        self.feed(page)
        self.close()
        self.flush()

    def flush(self):
        if text := " ".join("".join(self.held).split()):
            self.blocks.append(text)
        self.held = []

    def step(self, tag, by):
        if tag in self.BLOCKS:
            self.flush()
        self.inside += by * (tag == "article")
        self.left_out += by * (tag in self.OTHERS)

    def handle_starttag(self, tag, attrs):
        self.step(tag, 1)

    def handle_endtag(self, tag):
        self.step(tag, -1)

    def handle_data(self, data):
        if self.inside and not self.left_out:
            self.held.append(data)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_articles_of_all_pages(spark, sf):
    folder = f"/root/testdata/{sf}"
    if not os.path.isdir(folder):
        pytest.skip("no tables here")
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    wanted = {r["page_id"]: "\n".join(ArticleReader(r["html"] or "").blocks) for r in pages.collect()}
    assert {r["page_id"]: r["text"] for r in html_text.extract(pages).collect()} == wanted
    # where a host has enough pages the counts alone find the same, without names, classes and roles
    many = pages.join(pages.groupBy(html_text.host_column().alias("host")).count().filter(f"count >= {html_text.MIN_PAGES}"), html_text.host_column() == F.col("host"), "left_semi")
    rows = html_text.extract(many, names=False).collect()
    assert {r["page_id"]: r["text"] for r in rows} == {r["page_id"]: wanted[r["page_id"]] for r in rows}
    bare = {r["page_id"]: r["text"] for r in html_text.extract(many, min_pages=10**9, names=False).collect()}
    assert not rows or all(bare[r["page_id"]] != r["text"] for r in rows)  # and change every page


def site(n, inner):
    """A page of a site without semantic names: a bar, a box of changing words, a text, links and readers' words."""
    return f"<body><div class=x1><a href=/{n}>One {n}</a> <a>Two</a></div><div class=x2 id=b{n}>Buy {n * 7} things</div><div class=x3>{inner}</div><div class=x4><div>Reader {n}</div><div>So true {n}</div></div></body>"


def test_templates_without_names(spark):
    """Counts tell a site's parts from its text although no tag or class says what they are."""
    body = lambda n: f"<h1>Title {n}</h1><p>{' '.join(f'word{n}x{i}' for i in range(60))}</p><div><a>Print</a></div><p>Last {n}.</p>"
    pages = [(n, f"https://s.example/{n}", site(n, body(n))) for n in range(20)] + [(50 + n, f"https://t.example/{n}", site(n, body(n))) for n in range(3)]
    found = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)).collect()}
    for n in range(20):
        assert found[n] == f"Title {n}\n{' '.join(f'word{n}x{i}' for i in range(60))}\nLast {n}."
    assert "Buy 7 things" in found[51]  # on three pages nothing can be counted, and no name says what it is


def test_reader_comments_in_an_article_go(spark):
    page = lambda n: f"<body><nav>a b {n}</nav><article><h1>T{n}</h1><p>{'some words of this page ' * 9}{n}</p><section class='comments'><p>First {n}!</p></section><form>Mail</form></article></body>"
    pages = spark.createDataFrame([(n, f"http://c.example/{n}", page(n)) for n in range(9)], "page_id long, url string, html string")
    assert all(r["text"].split("\n")[0] == f"T{r['page_id']}" and len(r["text"].split("\n")) == 2 for r in html_text.extract(pages).collect())


def misleading(n, extra=""):
    """A page whose class names say other things than its parts are."""
    words = " ".join(f"word{n}x{i}" for i in range(40))
    inner = f"<div class='post-header header'><h1>Title {n}</h1></div><p>{words}</p><section class='share-prices share'><p>Shares rose {n}.</p></section><div class='notice-period notice'>Notice {n * 3}</div><div class='related'><p>Related to {n + 1}</p></div>{extra}"
    return f"<body><div class='content'>Home {n} page</div><article>{inner}</article><div class='main article'>Join {n * 7} now</div></body>"


def test_counts_overrule_misleading_names(spark):
    """On a counted host class names decide nothing in an article, but for readers' words that recur in shape."""
    comments = "<div class='comments'><p>First!</p><p>So true</p></div>"
    pages = [(n, f"https://m.example/{n}", misleading(n, comments)) for n in range(20)] + [(100, "https://few.example/1", misleading(1))]
    found = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)).collect()}
    for n in range(20):
        assert found[n].split("\n") == [f"Title {n}", " ".join(f"word{n}x{i}" for i in range(40)), f"Shares rose {n}.", f"Notice {n * 3}", f"Related to {n + 1}"]
    assert "Title 1" not in found[100] and "word1x0" in found[100]  # where nothing can be counted, labels are all there is
    single = "<article><div class='post-header'><h1>T</h1></div><section class='share-prices'>Up</section><div class='notice-period'>N</div><p>Body.</p></article>"
    assert html_text.main_text(single) == "T\nUp\nN\nBody."  # words that only begin or end like a label are none


def test_copies_of_a_page_make_no_template(spark):
    pages = [(n, "http://d.example/a", "<body><div>One text, the same on each</div></body>") for n in range(30)]
    assert {r["text"] for r in html_text.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()} == {"One text, the same on each"}


def test_broken_pages_take_linear_time():
    import time

    for part in ('<a "', "<a '\"", "<!", "<a ", "</x>", "<p><div><b>", "<li><ul>", '<a "\'>', "&lt", "<td>", "<a x='\" "):
        begin = time.process_time()
        html_text.main_text(part * 60_000)
        assert time.process_time() - begin < 15, part


# simhash
def print_of(text):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(codes, reach=3):
    label = list(range(len(codes)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(codes):
            for j, b in enumerate(codes):
                if (a ^ b).bit_count() <= reach and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    return label


def test_near_copies(spark):
    chance = random.Random(6)
    word = lambda: "".join(chance.choice("abcdefgh") for _ in range(5))
    texts = []
    for _ in range(60):
        words = [word() for _ in range(chance.randint(1, 400))]
        texts.append(" ".join(words))
        for _ in range(chance.randint(0, 3)):
            words[chance.randrange(len(words))] = word()
            texts.append(" ".join(words).upper() if chance.random() < 0.3 else " ".join(words))
    texts += ["", None, "É é", "a", "a  B"]
    rows = sorted(simhash.near_copies(documents(spark, texts)).collect())
    codes = [print_of(t) for t in texts]
    assert [int(r["fingerprint"], 16) for r in rows] == codes
    assert [r["component_id"] for r in rows] == classes(codes)


def test_fingerprints_of_long_texts(monkeypatch):
    """A long text is read a piece at a time, and its bits are counted a part at a time."""
    chance = random.Random(15)
    texts = [" ".join(f"w{chance.randint(0, 50)}" for _ in range(n)) + end for n in (0, 1, 2, 3, 50, 900) for end in ("", "  \n")]
    wanted = [print_of(t) for t in texts]
    for piece, held in ((7, 10), (64, 100), (1 << 20, 1 << 17)):
        monkeypatch.setattr(simhash, "PIECE", piece)
        monkeypatch.setattr(simhash, "HELD", held)
        assert simhash.fingerprints_of([t.encode() for t in texts]).tolist() == wanted


@pytest.mark.parametrize("blocks", [1, 2, 4])
def test_links_find_every_component(spark, blocks):
    chance = np.random.default_rng(7)
    base = chance.integers(0, 2**63, 150, dtype=np.uint64)
    near = [int(b) ^ (1 << int(k)) ^ (1 << int(m)) for b in base[:60] for k, m in chance.integers(0, 64, (3, 2))]
    codes = np.unique(np.concatenate([base, np.array(near, np.uint64)]))
    points = spark.createDataFrame([(int(c),) for c in codes.view(np.int64)], "fingerprint long")
    found = {r["node"]: r["root"] for r in stars(simhash.links(points, blocks=blocks, sample=64, leaf=16, part=40)).collect()}
    signed = codes.view(np.int64).tolist()
    wanted = classes([int(c) for c in codes])
    groups = {}
    for s, w in zip(signed, wanted):
        groups.setdefault(w, []).append(s)
    assert found == {s: min(g) for g in groups.values() for s in g if s != min(g)}


def test_vantage_trees():
    chance = np.random.default_rng(8)
    codes = chance.integers(0, 2**32, 2000, dtype=np.uint64)
    tree = VantageTree.build(codes[:500], 20)
    rows, leaves = tree.route(codes, 0)
    assert len(rows) == len(codes) and tree.leaves > 10  # a ball of radius 0 meets one shard
    rows, leaves = tree.route(codes, 2)
    held = {}
    for r, leaf in zip(rows.tolist(), leaves.tolist()):
        held.setdefault(leaf, set()).add(r)
    i, j = np.nonzero(np.bitwise_count(codes[:, None] ^ codes[None, :]) <= 2)
    assert all(any(a in s and b in s for s in held.values()) for a, b in zip(i.tolist(), j.tolist()) if a < b)
    same = np.full(3000, 5, np.uint64)
    assert (linked_groups(same, 3) == 0).all()
    tight = np.unique(np.array([1 << (a % 20) | 1 << (a % 17 + 20) for a in range(3000)], np.uint64))
    assert len(set(linked_groups(tight, 3).tolist())) == len(set(classes([int(c) for c in tight])))


def test_chains_become_stars(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (5, 5)], "a long, b long")
    assert {r["node"]: r["root"] for r in stars(chain).collect()} == {**{i: 0 for i in range(1, 41)}, 101: 100}
    assert stars(chain.filter("false")).count() == 0


def test_rounds_leave_sizes_as_they_are(spark, capsys):
    chain = spark.createDataFrame([(i, i + 1) for i in range(100)], "a long, b long")
    stars(chain).explain("cost")
    sizes = re.findall(r"sizeInBytes=([^,)]+)", capsys.readouterr().out)
    assert sizes and all(re.fullmatch(r"[\d.]+ (B|KiB)", x) for x in sizes), sizes


def test_simhash_odd(spark, nothing):
    rows = simhash.near_copies(odd(spark)).collect()
    assert len(rows) == 10
    assert {r["component_id"] for r in rows if r["fingerprint"] == "0" * 16} == {1}
    kept = simhash.drop_near_copies(odd(spark))
    assert kept.columns == odd(spark).columns
    assert kept.count() == len({r["fingerprint"] for r in rows})
    assert simhash.near_copies(nothing).count() == simhash.drop_near_copies(nothing).count() == 0


# byte-level BPE
@pytest.fixture(scope="module")
def tokenizer():
    import base64

    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, bpe.rank_file().splitlines())}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_library(tokenizer):
    chance = random.Random(9)
    alphabet = "abstmdrvle'' \n\t  .,!?09é漢ñ   🙂ĐА٣²½_-"
    texts = ["", None, "'", "it's we've I'll y'all're", "  ", " 's", "x" * 3000, "ab" * 2000, "\n" * 70, "<|endoftext|>", "\x00"]
    texts += ["".join(chance.choice(alphabet) for _ in range(chance.randint(0, 90))) for _ in range(6000)]
    words = bpe.Vocabulary(bpe.rank_file())
    ids, offsets, begin = words.encode(pa.array(texts))
    decoded = words.decode(ids, begin)
    for k, text in enumerate(texts):
        own = ids[begin[k] : begin[k + 1]].tolist()
        data = (text or "").encode()
        assert own == tokenizer.encode_ordinary(text or "")
        assert bytes(decoded[k]) == data
        ends = [*offsets[begin[k] : begin[k + 1]].tolist(), len(data)]
        assert all(data[a:b] == tokenizer.decode_single_token_bytes(i) for a, b, i in zip(ends, ends[1:], own))
    words.CACHED = 10
    assert words.encode(pa.array(texts))[0].tolist() == ids.tolist()


def test_bpe_of_every_code_point(tokenizer):
    points = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    texts = ["".join(x for c in points[at : at + 64] for x in (c, "a", c, " ", c, "1")) for at in range(0, len(points), 64)]
    ids, _, begin = bpe.Vocabulary(bpe.rank_file()).encode(pa.array(texts))
    assert all(ids[begin[k] : begin[k + 1]].tolist() == tokenizer.encode_ordinary(t) for k, t in enumerate(texts))


def test_bpe_queries(spark, tokenizer, nothing):
    docs = odd(spark)
    encoded = bpe.encode(docs)
    rows = encoded.join(docs.select("doc_id", "text").distinct(), "doc_id").collect()
    assert all(r["ids"] == tokenizer.encode_ordinary(r["text"] or "") for r in rows)
    back = {r["doc_id"]: bytes(r["text"]) for r in bpe.decode(encoded).collect()}
    assert back[7] == "\x00é漢🙂".encode() and back[5] == LONG.encode() and back[1] == b""
    for r in bpe.round_trip(docs).filter("doc_id in (3, 5, 7)").collect():
        text = {3: "same text here", 5: LONG, 7: "\x00é漢🙂"}[r["doc_id"]]
        own = tokenizer.encode_ordinary(text)
        assert (r["n_tokens"], r["ids_sha256"]) == (len(own), hashlib.sha256(np.array(own, "<u4").tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.encode(nothing).count() == bpe.round_trip(nothing).count() == bpe.decode(bpe.encode(nothing)).count() == 0


# classifiers
def corpus(spark, n=600):
    chance = random.Random(10)
    words = ["tree", "river", "stone", "cloud", "quiet", "walks", "under", "green", "light", "paper", "house", "north"]
    rows, labels = [], []
    for i in range(n):
        text = ". ".join(" ".join(chance.choice(words) for _ in range(9)).capitalize() for _ in range(chance.randint(2, 9))) + "."
        good = chance.random() < 0.7
        if not good:
            text = chance.choice([lambda t: t.upper().replace(" ", "!! "), lambda t: " | ".join(t.split()), lambda t: " ".join(w for w in t.split() for _ in range(12)), lambda t: t.replace(" ", "### ")])(text)
        toxic = chance.random() < 0.3
        if toxic:
            text += " You " + " and ".join(chance.sample(["blorf", "snark", "grumph", "zorble", "vextin"], chance.randint(1, 4)))
        rows.append(text)
        labels.append((i, int(good), int(toxic)))
    return documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality(spark, nothing):
    docs, labels = corpus(spark)
    rows = quality.quality_scores(docs, labels).join(labels, "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["predicted"] == r["quality"] for r in held) / len(held) > 0.95
    kept = quality.keep_quality(docs, labels)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(r["doc_id"] for r in rows if r["predicted"])
    # held-out labels aren't looked at
    other = labels.withColumn("quality", F.when(quality.held_out_column(), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert sorted(quality.quality_scores(docs, other).collect()) == sorted(quality.quality_scores(docs, labels).collect())
    assert quality.quality_scores(odd(spark), labels).count() == 10
    assert quality.quality_scores(nothing, labels).count() == 0
    for kind in (0, 1):  # labels of one kind reject nothing
        assert {r["score"] for r in quality.quality_scores(docs, labels.filter(F.col("quality") == kind)).collect()} == {1.0}
    # a doc_id with two texts is learnt by its least, wherever its rows lie
    twice = docs.union(docs.withColumn("text", F.concat(F.lit("zz "), "text")))
    assert sorted(quality.quality_scores(twice, labels).collect()) == sorted(quality.quality_scores(twice.repartition(7), labels).collect())


def test_rules_as_columns(spark):
    chance = np.random.default_rng(11)
    x = chance.random((400, 3))
    y = ((x[:, 0] > 0.5) & (x[:, 1] <= 0.3) | (x[:, 2] > 0.9)).astype(float)
    rules, intercept = quality.fit(x, y, trees=20)
    margin = intercept + sum(r.weight * r.holds(x) for r in rules)
    assert ((margin > 0) == (y > 0)).mean() > 0.95
    frame = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double")
    scores = [r[0] for r in frame.select(quality.score_column(rules, intercept, [F.col(c) for c in "abc"])).collect()]
    assert scores == pytest.approx(quality.sigmoid(margin).tolist())


def test_toxicity(spark, nothing):
    docs, labels = corpus(spark)
    rows = toxicity.toxicity(docs, labels).join(labels, "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert sum(r["predicted"] == r["toxic"] for r in held) / len(held) > 0.95
    assert all(0 <= r["expected_severity"] <= 2 and r["severity"] in (0, 1, 2) for r in rows)
    mean = lambda k: np.mean([r["expected_severity"] for r in rows if r["severity"] == k])
    assert mean(0) < mean(1) < mean(2)
    assert toxicity.toxicity(odd(spark), labels).count() == 10
    assert toxicity.toxicity(nothing, labels).count() == 0
    for kind in (0, 1):  # labels of one kind tell nothing
        rows = toxicity.toxicity(docs, labels.filter(F.col("toxic") == kind)).collect()
        assert {(r["predicted"], r["severity"]) for r in rows} == {(0, 0)} and max(r["expected_severity"] for r in rows) < 1e-9


def test_toxicity_is_held_out(spark):
    """Held-out accuracy on the given tables: labels of held-out rows aren't looked at."""
    folder = "/root/testdata/sf0.1"
    if not os.path.isdir(folder):
        pytest.skip("no tables here")
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.toxicity(docs, labels).filter("held_out").join(labels, "doc_id").collect()
    toxic = [r["predicted"] for r in rows if r["toxic"]]
    assert sum(toxic) / len(toxic) > 0.9
    assert sum(r["predicted"] for r in rows if not r["toxic"]) <= 0.01 * len(rows)


def test_terms():
    assert toxicity.terms_of("Abcdefg abcdefh ABCDEX abc_d 12") == {"abcdefg", "abcdefh", "abcdex", "abc", "d", "12", "abcde*2", "abcde*3", "abcdef*2"}
    assert toxicity.terms_of(None) == set()
    long = "wörter und Wörter " * 200_000
    assert toxicity.words_of(long) == set(toxicity.WORDS.findall(long.lower()))


def test_cumulative_fit_is_the_least_loss():
    """The fit against the loss itself, written out row by row: nothing near it is better."""
    import math

    from csift.llm.linear import Rows, fit_cumulative

    chance, shrink = np.random.default_rng(21), 2e-3
    terms = [sorted(set(chance.integers(0, 6, chance.integers(1, 5)).tolist())) for _ in range(300)]
    grades = np.array([min(2, sum(t < 2 for t in x) + int(chance.random() < 0.2)) for x in terms])
    weights, cuts = fit_cumulative(Rows.of(terms, {i: i for i in range(6)}), grades, 3, shrink)

    def loss(w, c):
        total = shrink * sum(map(abs, w))
        for x, g in zip(terms, grades):
            z = sum(w[t] for t in x)
            over = [1.0, *(1 / (1 + math.exp(v - z)) for v in c), 0.0]
            total -= math.log(over[g] - over[g + 1]) / len(terms)
        return total

    best = loss(weights, cuts)
    for _ in range(150):
        size = 10.0 ** -chance.integers(1, 4)
        assert loss(weights + chance.normal(size=6) * size, cuts + chance.normal(size=2) * size * 0.3) > best - 1e-9


def test_severity_follows_a_planted_scale(spark):
    """Labels say toxic or not; how many telling words a text has is what severity is meant to follow, and does."""
    chance = random.Random(31)
    plain, foul = [f"word{i}" for i in range(200)], [f"foul{i}x" for i in range(12)]
    planted = {i: chance.choice([0, 0, 0, 1, 2, 3, 5]) for i in range(900)}
    texts = {i: chance.choices(plain, k=30) + chance.sample(foul, n) for i, n in planted.items()}
    docs = spark.createDataFrame([(i, " ".join(chance.sample(t, len(t)))) for i, t in texts.items()], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(n > 0)) for i, n in planted.items()], "doc_id long, quality int, toxic int")
    rows = [r for r in toxicity.toxicity(docs, labels).collect() if r["held_out"]]
    mean = lambda n: np.mean([r["expected_severity"] for r in rows if planted[r["doc_id"]] == n])
    assert mean(0) < 0.2 < mean(1) < mean(2) < mean(3) <= mean(5) + 0.05
    assert np.mean([r["severity"] for r in rows if planted[r["doc_id"]] >= 3]) > 1.5 and np.mean([r["severity"] for r in rows if planted[r["doc_id"]] == 1]) < 1.6


def test_cumulative_links_keep_order():
    chance = np.random.default_rng(12)
    from csift.llm.linear import Rows, fit_cumulative, sigmoid

    terms = [sorted(set(chance.integers(0, 12, chance.integers(1, 6)).tolist())) for _ in range(800)]
    grades = np.array([min(2, sum(t < 3 for t in x)) for x in terms])
    rows = Rows.of(terms, {i: i for i in range(12)})
    weights, cuts = fit_cumulative(rows, grades, 3, 1e-4)
    assert cuts[0] < cuts[1] and weights[:3].min() > weights[3:].max()
    guess = (sigmoid(rows.times(weights)[:, None] - cuts) > 0.5).sum(1)
    assert (guess == grades).mean() > 0.9


def notices_by_hand(model, text):
    """All joins of lines of a block, in no clever way."""
    lines = [m.span() for m in re.finditer(r"[^\n]+", text) if m[0].strip()]
    words = [licenses.words_of(text[a:b]) for a, b in lines]
    pairs = lambda i, j: set(zip(sum(words[i : j + 1], []), sum(words[i : j + 1], [])[1:]))
    known = {p for family in licenses.NOTICES.values() for x in family for p in zip(licenses.words_of(x), licenses.words_of(x)[1:])}
    found = []
    for i in range(len(lines)):
        for j in range(i, len(lines)):
            apart = any(text[lines[k][1] : lines[k + 1][0]].count("\n") > 1 for k in range(i, j))
            if apart or sum(len(w) for w in words[i + 1 : j]) >= licenses.LONGEST:
                break
            if i == j or len(pairs(i, j) & known) > len(pairs(i, j - 1) & known):
                found.append((i, j, *model.family(text[lines[i][0] : lines[j][1]])))
    out, taken = [], set()
    for i, j, family, mass, alike in sorted((x for x in found if x[2] != licenses.UNKNOWN), key=lambda x: (-x[4], x[1] - x[0], x[0])):
        if not taken & set(range(i, j + 1)):
            taken |= set(range(i, j + 1))
            out.append((lines[i][0], lines[j][1], family, mass, alike))
    return sorted(out)


def test_licenses_by_hand():
    chance = random.Random(14)
    model = licenses.train(["The sun rose over the hills and a dog slept.", "Permission to leave was granted by the judge."] * 5)
    notices = [x for family in licenses.NOTICES.values() for x in family]
    hits = 0
    for _ in range(150):
        words = []
        for _ in range(chance.randint(1, 3)):
            words += chance.choice(notices if chance.random() < 0.7 else licenses.MENTIONS).split()
        text = "".join(w + chance.choice([" "] * 7 + ["\n", "\n // ", "\n\n", " \n \n"]) for w in words)
        mine = licenses.notices_in(model, text, licenses.paragraphs(text))
        assert mine == notices_by_hand(model, text), text
        hits += len(mine)
    assert hits > 60
    for family, own in licenses.NOTICES.items():
        for x in own:
            assert model.family(x)[0] == family
    assert not any(licenses.notices_in(model, x, licenses.paragraphs(x)) for x in licenses.MENTIONS)


def test_lines_without_words_take_linear_time():
    import time

    notice = "Licensed under the MIT License."
    for part in ("-----\n", "x\n", "mit\n", "of the\n"):
        lines = licenses.paragraphs(text := notice + "\n" + part * 40_000)
        begin = time.process_time()
        assert (0, 0) in [*licenses.joins(text, lines)]
        assert time.process_time() - begin < 20, part


def test_licenses(spark, nothing):
    plain = ["The sun rose over the hills.\nA dog slept.", "Permission to leave was granted by the judge.", "He has a license to drive in the state.", "MIT is in Massachusetts."] * 10
    texts = ["Intro line.\nReleased under the MIT License.\nEnd.", "© Ana. Licensed under the Apache License, Version 2.0.", "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.", "SPDX-License-Identifier: BSD-3-Clause"]
    wanted = [["MIT"], ["Apache-2.0"], ["GPL"], ["CC-BY-NC"], ["BSD"]]
    rows = sorted(licenses.license_scan(documents(spark, texts + plain)).collect())
    assert [r["families"] for r in rows] == wanted + [[]] * len(plain)
    hit = rows[0]["found"][0]
    assert texts[0][hit["begin"] : hit["end"]] == "Released under the MIT License." and hit["probability"] > 0.5 and hit["similarity"] == 1.0
    assert rows[0]["n_paragraphs"] == 3
    assert licenses.license_scan(odd(spark)).count() == 10
    assert licenses.license_scan(nothing).count() == 0


def test_wrapped_licenses(spark):
    plain = ["The sun rose over the hills.\nA dog slept.", "Permission to leave was granted by the judge.", "He has a license to drive in the state."] * 10
    bsd = "BSD 3-Clause\n\nCopyright (c) 2020, Ana\n\nRedistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n\n1. Copies stay."
    isc = "ISC\n\nPermission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice appears."
    lgpl = "/* This library is free software; you can redistribute it and/or\n * modify it under the terms of the GNU Lesser General Public\n * License as published by the Free Software Foundation; either\n * version 2.1 of the License, or (at your option) any later version. */"
    gpl = "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version 3 of the License, or\n# (at your option) any later version."
    narrow = "Permission\nto use,\ncopy,\nmodify,\nand/or\ndistribute\nthis\nsoftware\nfor any\npurpose\nwith or\nwithout fee\nis hereby\ngranted"
    two = "Released under the MIT License.\nLicensed under CC BY-NC 4.0."
    apart = "Redistribution and use in source and binary forms, with or without\n\n \nmodification, are permitted provided that the following conditions are met:"
    mit = "/*\n * Permission is hereby granted, free of charge, to any person obtaining a copy\n * of this software and associated documentation files, to deal\n * in the Software\n */"
    agpl = "# it under the terms of the GNU Affero General Public License as\n# published by the Free Software Foundation, either version 3"
    texts = [bsd, isc, lgpl, gpl, narrow, two, apart, mit, agpl, "it under the terms of the GNU General Public License as published by"]
    rows = sorted(licenses.license_scan(documents(spark, texts + plain)).collect())
    assert [r["families"] for r in rows] == [["BSD"], ["ISC"], ["LGPL"], ["GPL"], ["ISC"], ["CC-BY-NC", "MIT"], [], ["MIT"], ["AGPL"], []] + [[]] * len(plain)
    assert [r["n_licenses"] for r in rows[:6]] == [1, 1, 1, 1, 1, 2]
    hit = rows[0]["found"][0]
    assert bsd[hit["begin"] : hit["end"]].startswith("Redistribution") and bsd[hit["begin"] : hit["end"]].endswith("met:") and hit["similarity"] == 1.0
