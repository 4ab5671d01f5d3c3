"""URL filter, media columns, toxicity, the pipeline, and the registered SQL."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest

from gaugeworks.llm import op2_url_filter, op7_media, op9_toxicity, webp
from gaugeworks.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.sql(ORACLES[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)

    def key(frame):
        return sorted(tuple(None if v is None or v != v else v for v in r) for r in frame[cols].astype(object).itertuples(index=False))

    assert sorted(map(repr, key(got))) == sorted(map(repr, key(want)))


PAGES = [
    (1, "https://a.example.org/es/1", "<p>"),
    (2, "https://A.Example.org/en/12?x#y", None),
    (3, "http://x.com/de/1", ""),
    (4, "http://y.net/p", '<link rel="canonical" href="https://x.com/de/1">'),
    (5, "http://y.net/q", "<meta http-equiv='refresh' content='0; url=/p'>"),
    (6, "http://z.net/r", '<LINK href="http://y.net/q#frag" REL=canonical>'),
    (7, "http://z.net/allowed", '<link rel="canonical" href="http://b.org/x">'),
    (8, "http://z.net/mixed", '<link rel="canonical" href="http://x.com/de/9"><meta http-equiv="refresh" content="3;url=http://b.org/x9">'),
    (9, "http://b.org/x", '<link rel="canonical" href="http://x.com/de/1">'),
    (10, None, None),
    (11, "no address", "<link rel=canonical href=http://x.com/de/1>"),
    (12, "https://x.com", ""),
    (12, "https://x.com", ""),
    (13, "HTTP://Z.NET/r", ""),
    (14, "http://notexample.org.evil/es/", ""),
]


def test_urls(spark, duck):
    pages = spark.createDataFrame([(*p, "clash") for p in PAGES], "page_id long, url string, html string, rule string")
    got = {r["page_id"]: r for r in op2_url_filter.filter_urls(pages, op2_url_filter.RULES).collect()}
    assert (got[1]["host"], got[1]["path"], got[1]["rule"], got[1]["verdict"]) == ("a.example.org", "/es/1", "example.org/es/", "block")
    assert got[2]["rule"] == "example.org/en/1" and got[3]["rule"] == "com/de/"
    assert {k: got[k]["verdict"] for k in (4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14)} == {4: "allow", 5: "allow", 6: "allow", 7: "allow", 8: "allow", 9: "allow", 10: "allow", 11: "allow", 12: "allow", 13: "allow", 14: "allow"}
    without = spark.createDataFrame([p for p in PAGES if p[0] != 9], "page_id long, url string, html string")
    got = {r["page_id"]: r["verdict"] for r in op2_url_filter.filter_urls(without, op2_url_filter.RULES).collect()}
    assert (got[4], got[5], got[6], got[13], got[7]) == ("block", "block", "block", "block", "allow")
    assert op2_url_filter.filter_urls(without.limit(0), op2_url_filter.RULES).count() == 0


def test_url_sql_follows_aliases(spark):
    import duckdb
    import pandas as pd

    con = duckdb.connect()
    pages = pd.DataFrame(PAGES, columns=["page_id", "url", "html"])
    con.register("pages", pages)
    want = sorted(con.sql(op2_url_filter.ORACLE).df().astype(object).where(lambda f: f.notna(), None).itertuples(index=False), key=repr)
    rows = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    got = sorted(op2_url_filter.filter_urls(rows, op2_url_filter.RULES).collect(), key=repr)
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, (tuple(r) for r in want)))


def test_url_links_are_resolved(spark):
    link, refresh = '<link rel="canonical" href="{}">'.format, '<meta http-equiv="refresh" content="0;url={}">'.format
    pages = [
        (1, "http://x.com/a/b/p", link("../../de/1")),
        (2, "http://x.com/a/q", link("./../../de/./2")),
        (3, "http://y.net/f.html", link("?q=1")),
        (4, "http://y.net/f.html?q=1", link("http://x.com/de/3")),
        (5, "http://y.net/g", link("http://y.net/h?a=1&amp;b=&#x32;&#50;&amp;lt;&no;")),
        (6, "http://y.net/h?a=1&b=22&lt;&no;", link("http://x.com/de/4")),
        (7, "http://y.net/k", link("http://y.net/other") + link("http://x.com/de/5")),
        (8, "http://y.net/l", refresh("/other2") + refresh("http://x.com/de/6")),
        (9, "http://y.net/d/", link("http://x.com/de/7")),
        (10, "http://y.net/d/m", link("#top")),
        (11, "http://y.net/c/../n", link("http://x.com/de/8")),
        (12, "http://y.net/n", ""),
        (13, "http://y.net/o", link("http://x.com/de/..")),
    ]
    got = {r["page_id"]: r["verdict"] for r in op2_url_filter.filter_urls(spark.createDataFrame(pages, "page_id long, url string, html string"), op2_url_filter.RULES).collect()}
    assert got == {k: "allow" if k in (10, 13) else "block" for k in range(1, 14)}


#: Pages whose links only a reader of attributes gets right, and whether what they name is blocked.
ATTRIBUTES = [
    ('<link data-rel="canonical" rel="alternate" href="http://x.com/de/1">', False),
    ('<!-- <link rel="canonical" href="http://x.com/de/1"> -->', False),
    ('<link rel="canonical" data-href="http://y.net/n" href="http://x.com/de/1">', True),
    ('<link rel="alternate canonical" href="http://x.com/de/1">', True),
    ('<base href="http://x.com/de/"><link rel="canonical" href="1">', True),
    ("<meta http-equiv=\"refresh\" content='0; url = \"http://x.com/de/1\"'>", True),
    ('<link rel="canonical-x" href="http://x.com/de/1">', False),
    ('<link title="rel=canonical" href="http://x.com/de/1">', False),
    ('<script>var s = \'<link rel="canonical" href="http://x.com/de/1">\';</script>', False),
    ('<link title="a > b" rel="canonical" href="http://x.com/de/1">', True),
    ('<link rel=canonical href="  http://x.com/de/1 ">', True),
    ('<meta content="0;http://x.com/de/1" http-equiv="Refresh">', True),
    ('<meta http-equiv="refresh" content="5">', False),
    ('<style>/* <link rel="canonical" href="http://x.com/de/1"> */</style>', False),
    ('<LINK REL = "CANONICAL"\n HREF = \'http://x.com/de/1\' />', True),
    ('<linker rel="canonical" href="http://x.com/de/1">', False),
]


def test_links_are_read_by_attributes(spark):
    import duckdb
    import pandas as pd

    pages = [(k, f"http://y.net/{k}", html) for k, (html, _) in enumerate(ATTRIBUTES)]
    want = {k: "block" if blocked else "allow" for k, (_, blocked) in enumerate(ATTRIBUTES)}
    frame = spark.createDataFrame([(*p, "a", "b", "c", "d", "e") for p in pages], "page_id long, url string, html string, host string, path string, verdict string, address string, action string")
    assert {r.page_id: r.verdict for r in op2_url_filter.filter_urls(frame, op2_url_filter.RULES).collect()} == want
    con = duckdb.connect()
    con.register("pages", pd.DataFrame(pages, columns=["page_id", "url", "html"]))
    assert dict(con.sql(f"SELECT page_id, verdict FROM ({op2_url_filter.ORACLE})").fetchall()) == want


def test_odd_pages_are_read(spark):
    for html in ("", "<", "<link", "<link rel=canonical href=", "<!-- canonical", "<meta http-equiv=refresh content=>", "<base><base href='/x'>" * 3, "<![x[ canonical", '<link rel="canonical" ' + '"' * 5000 + ">"):
        assert isinstance(op2_url_filter.links_of(html)[1], list)


def test_rules_are_checked():
    with pytest.raises(ValueError):
        op2_url_filter.rules("deny x/")


def feature_image(transforms, cache=0, seed=0, width=19, height=11, colours=None, meta=False):
    """An image in the reader's terms and a stream that holds it with the given features."""
    rng = np.random.default_rng(seed)
    table = rng.integers(0, 1 << 32, colours or 40, dtype=np.uint64).astype(np.uint32)
    image = table[rng.integers(0, len(table), (height, width))]
    out = webp.start(width, height, True)
    now = image

    def entropy(pixels, cache_bits=0, main=False):
        flat = [int(p) for p in pixels.ravel()]
        out.put(int(cache_bits > 0), 1)
        if cache_bits:
            out.put(cache_bits, 4)
        if main:
            out.put(int(meta), 1)
            if meta:
                out.put(0, 3)  # blocks of four pixels
                entropy(np.zeros((-(-pixels.shape[0] // 4), -(-pixels.shape[1] // 4)), np.uint32))
        size = 280 + (1 << cache_bits if cache_bits else 0)
        store, symbols, i = {}, [], 0
        while i < len(flat):
            run = 0
            if main:
                while i and i + run < len(flat) and flat[i + run] == flat[i + run - 1] and run < 4:
                    run += 1
            slot = (webp.CACHE_MULTIPLIER * flat[i] & 0xFFFFFFFF) >> (32 - cache_bits) if cache_bits else 0
            if run >= 2:
                symbols.append(("copy", run))
                for p in flat[i : i + run]:
                    store[(webp.CACHE_MULTIPLIER * p & 0xFFFFFFFF) >> (32 - cache_bits) if cache_bits else 0] = p
                i += run
                continue
            symbols.append(("cache", slot) if cache_bits and store.get(slot) == flat[i] else ("pixel", flat[i]))
            store[slot] = flat[i]
            i += 1
        flatten = {s: 8 for s in range(256)}
        green = {s: 10 for s in range(size)}
        green = webp.code_lengths({s: 1 for s in range(size)}, 15)
        codes = [green, flatten, flatten, flatten, webp.code_lengths({s: 1 for s in range(40)}, 15)]
        for lengths in codes:
            webp.put_code(out, lengths)
        words = [webp.canonical(c) for c in codes]

        def put(k, s):
            out.put(words[k][s], codes[k][s])

        for kind, value in symbols:
            if kind == "pixel":
                put(0, value >> 8 & 255)
                put(1, value >> 16 & 255)
                put(2, value & 255)
                put(3, value >> 24)
            elif kind == "cache":
                put(0, 280 + value)
            else:
                put(0, 256 + value - 1)  # lengths up to four have no extra bits
                put(4, 1)  # the second near distance: one pixel to the left
    for t in transforms:
        out.put(1, 1)
        out.put(t[0], 2)
        if t[0] == webp.PREDICTOR:
            out.put(0, 3)
            modes = rng.integers(0, 16, (-(-height // 4), -(-now.shape[1] // 4)), dtype=np.uint32) if t[1] is None else np.full((-(-height // 4), -(-now.shape[1] // 4)), t[1], np.uint32)
            entropy(modes << np.uint32(8))
            c = webp._channels(now).astype(np.int64)
            residual = np.zeros_like(c)
            for y in range(height):
                for x in range(now.shape[1]):
                    if y == 0:
                        p = c[0, x - 1] if x else np.array([0, 0, 0, 255])
                    elif x == 0:
                        p = c[y - 1, 0]
                    else:
                        right = c[y - 1, x + 1] if x + 1 < now.shape[1] else c[y, 0]
                        p = webp.predict(int(modes[y >> 2, x >> 2]), *(v.astype(np.uint8) for v in (c[y, x - 1], c[y - 1, x], right, c[y - 1, x - 1])))
                    residual[y, x] = (c[y, x] - p) & 255
            now = webp._argb(residual.astype(np.uint8))
        elif t[0] == webp.CROSS_COLOUR:
            out.put(0, 3)
            f = rng.integers(0, 1 << 24, (-(-height // 4), -(-now.shape[1] // 4)), dtype=np.uint64).astype(np.uint32)
            entropy(f)
            c = webp._channels(now).astype(np.int64)
            m = webp._channels(f).view(np.int8).astype(np.int64)[np.arange(height)[:, None] >> 2, np.arange(now.shape[1])[None] >> 2]
            signed = lambda v: v.astype(np.uint8).view(np.int8).astype(np.int64)
            g, r = signed(c[..., 1]), signed(c[..., 2])
            blue = (c[..., 0] - (m[..., 1] * g >> 5) - (m[..., 2] * r >> 5)) & 255
            red = (c[..., 2] - (m[..., 0] * g >> 5)) & 255
            now = webp._argb(np.stack([blue, c[..., 1], red, c[..., 3]], -1).astype(np.uint8))
        elif t[0] == webp.SUBTRACT_GREEN:
            c = webp._channels(now).copy()
            c[..., 0] -= c[..., 1]
            c[..., 2] -= c[..., 1]
            now = webp._argb(c)
        else:
            palette, index = np.unique(now, return_inverse=True)
            n = len(palette)
            out.put(n - 1, 8)
            entropy(webp._argb(np.diff(webp._channels(palette[None]), axis=1, prepend=np.zeros((1, 1, 4), np.uint8)).astype(np.uint8)))
            bundle = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            index = index.reshape(now.shape).astype(np.uint32)
            per = 1 << bundle
            wide = np.zeros((height, -(-index.shape[1] // per) * per), np.uint32)
            wide[:, : index.shape[1]] = index
            packed = sum(wide[:, k::per] << np.uint32(k * (8 >> bundle)) for k in range(per)) if bundle else wide
            now = packed.astype(np.uint32) << np.uint32(8) | np.uint32(0xFF000000)
    out.put(0, 1)
    entropy(now, cache, main=True)
    return image, out.tobytes()


CASES = [([], 0, None), ([], 5, None), ([(2,)], 0, None), ([(1,)], 3, None), ([(0, None)], 0, None), ([(0, None), (1,), (2,)], 4, None), ([(3,)], 0, 2), ([(3,)], 0, 4), ([(3,)], 2, 11), ([(3,)], 0, 40), ([(3,), (0, None)], 0, 16)]
CASES += [([(0, m)], 0, None) for m in range(14)]


@pytest.mark.parametrize(("transforms", "cache", "colours"), CASES)
def test_webp_features(transforms, cache, colours):
    image, stream = feature_image(transforms, cache, seed=len(transforms) + cache, colours=colours)
    assert np.array_equal(webp.read_stream(stream), image)
    assert np.array_equal(webp.read_images([webp.container(stream)])[0], webp._channels(image)[..., 2::-1].ravel())


def test_webp_streams_of_all_kinds_in_step():
    made = [feature_image(t, c, seed=k, width=7 + k, height=5 + 3 * k, colours=n, meta=k % 3 == 0) for k, (t, c, n) in enumerate(CASES)]
    read = webp.read_images([webp.container(stream) for _, stream in made])
    assert all(np.array_equal(r, webp._channels(image)[..., 2::-1].ravel()) for r, (image, _) in zip(read, made, strict=True))
    with pytest.raises(ValueError):
        webp.read_images([webp.container(stream[: len(stream) // 2]) for _, stream in made])


def test_webp_stream_put_together_from_the_specification():
    """Four equal pixels: one literal and a copy of three from the left; every bit is written out here."""
    fields = [(0x2F, 8), (3, 14), (0, 14), (0, 1), (0, 3)]  # signature, width - 1, height - 1, no alpha, version
    fields += [(0, 1), (0, 1), (0, 1)]  # no transform, no colour cache, no meta codes
    # Green: a normal code. Four lengths of the length code, for 17, 18, 0 and 1: 18 and 1 have one bit (1: 0, 18: 1).
    fields += [(0, 1), (0, 4), (0, 3), (1, 3), (0, 3), (1, 3), (0, 1)]
    # 65 zeros, one bit for 65; 138 + 54 zeros, one bit for 258; 21 zeros.
    fields += [(1, 1), (65 - 11, 7), (0, 1), (1, 1), (138 - 11, 7), (1, 1), (54 - 11, 7), (0, 1), (1, 1), (21 - 11, 7)]
    fields += [(1, 1), (0, 1), (1, 1), (67, 8), (1, 1), (0, 1), (1, 1), (68, 8), (1, 1), (0, 1), (1, 1), (255, 8)]  # red, blue, alpha: one symbol each
    fields += [(1, 1), (0, 1), (0, 1), (1, 1)]  # distance: symbol 1, code 2, one pixel to the left
    fields += [(0, 1), (1, 1)]  # literal 65; length symbol 258, three pixels
    value = size = 0
    for v, bits in fields:
        value |= v << size
        size += bits
    stream = value.to_bytes(-(-size // 8), "little")
    assert webp.read_images([webp.container(stream)])[0].tolist() == [67, 65, 68] * 4
    assert (webp.read_stream(stream) == 0xFF434144).all()


def features(image):
    """The transforms of an image, and whether its codes hold back-references and cache hits."""
    bits, _, height, steps, now = webp._head(webp._payload(image)[0])
    cache, _, _, groups = webp._groups(bits, now, height, True)
    green = groups[0][0].table >> 4
    return {s[0] for s in steps}, bool(((green >= 256) & (green < 280)).any()), cache > 0 and bool((green >= 280).any())


def test_media_images_use_the_features_of_the_format():
    rng = np.random.default_rng(4)
    word = lambda: bytes(rng.integers(97, 123, 6).tolist())
    words = [word() for _ in range(60)]
    base, g = rng.integers(33, 60, 192), rng.integers(40, 120, 64 * 40)
    noise = rng.integers(33, 120, 64 * 40)
    cases = {
        "palette": b"".join([b"abcabdabe"[3 * k : 3 * k + 3] for k in rng.integers(0, 3, 64 * 20)]),
        "above": np.concatenate([base + y for y in range(60)]).astype(np.uint8).tobytes(),
        "left": np.clip(np.cumsum(rng.integers(-1, 2, (64 * 60, 3)), 0) % 90 + 33, 33, 122).astype(np.uint8).tobytes(),
        "green": np.repeat(g, 3).astype(np.uint8).tobytes(),
        "cross": np.stack([30 + g // 2, g, noise], 1).astype(np.uint8).tobytes(),
        "text": b"".join(words[k] for k in rng.integers(0, 60, 1600)),
        "again": rng.integers(97, 123, 192 * 8).astype(np.uint8).tobytes() * 4,
    }
    samples = [np.frombuffer(op7_media.payload_of(c.decode()), np.uint8) for c in cases.values()]
    images = webp.write_images(samples, op7_media.WIDTH)
    assert all(np.array_equal(a, b) for a, b in zip(webp.read_images(images), samples, strict=True))
    assert images == [webp.write_images([s], op7_media.WIDTH)[0] for s in samples]
    got = {k: features(i) for k, i in zip(cases, images, strict=True)}
    assert webp.PALETTE in got["palette"][0] and webp.SUBTRACT_GREEN in got["green"][0] and webp.CROSS_COLOUR in got["cross"][0]
    assert webp.PREDICTOR in got["above"][0] and webp.PREDICTOR in got["left"][0]
    assert got["again"][1] and got["text"][2]


def test_webp_meta_codes_and_damage():
    image, stream = feature_image([(2,)], 3, meta=True)
    assert np.array_equal(webp.read_stream(stream), image)
    with pytest.raises(ValueError):
        webp.read_stream(stream[: len(stream) // 2])
    with pytest.raises(ValueError):
        webp.read_images([b"RIFF0000WEBPVP8 "])


def test_webp_lockstep_equals_the_general_reader():
    rng = np.random.default_rng(1)
    samples = [rng.choice(np.arange(256, dtype=np.uint8), 192 * int(rng.integers(1, 9)), p=p / p.sum()) for p in (rng.random(256) ** k for k in (1, 3, 9, 30))] + [np.full(192, 32, np.uint8)]
    images = webp.write_images(samples, 64)
    assert all(np.array_equal(a, b) for a, b in zip(webp.read_images(images), samples, strict=True))
    for image, s in zip(images, samples, strict=True):
        assert np.array_equal(webp._channels(webp.read_stream(image[20:]))[..., 2::-1].ravel(), s)


def test_media_round_trip(spark, awkward, empty):
    long = spark.createDataFrame([(99, "ab c" * 40_000)], "doc_id long, text string")
    rows = awkward.select("doc_id", "text").unionByName(long)
    got = op7_media.decode_media(op7_media.encode_media(rows), payload=True).collect()
    want = []
    for d, t in rows.collect():
        data = (t or "").encode()
        padded = data + b" " * (max(1, -(-len(data) // 192)) * 192 - len(data))
        want.append((d, len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:])))
    assert sorted((tuple(g)[:5] for g in got), key=repr) == sorted(want, key=repr)
    assert len({(g["payload_sha256"], g["media_sha256"], g["feature"]) for g in got}) == len({g["payload_sha256"] for g in got})
    assert op7_media.decode_media(op7_media.encode_media(empty)).count() == 0


def toxic_texts(n, seed):
    rng = random.Random(seed)
    words = [f"word{i}" for i in range(400)]
    texts, labels = [], []
    for k in range(n):
        t = ["the"] + [rng.choice(words) for _ in range(rng.randint(5, 60))]
        if k % 4 == 0:
            for _ in range(2):
                t[rng.randrange(len(t))] = rng.choice(["vileful", "vileness", "grossly"])
        texts.append(" ".join(t))
        labels.append(int(k % 4 == 0))
    return texts, labels


def test_classifier_learns_words_and_prefixes():
    texts, labels = toxic_texts(900, 1)
    model = op9_toxicity.train(texts, labels, 1.0)
    fresh, truth = toxic_texts(300, 2)
    got = op9_toxicity.Scorer(model).scores(fresh)
    assert np.mean([(s >= 0.5) == bool(t) for s, t in zip(got, truth, strict=True)]) > 0.95
    assert op9_toxicity.Scorer(model).scores(["the vilest word1"])[0] > op9_toxicity.Scorer(model).scores(["the word2 word1"])[0]
    long = "the " + "word1 " * 50_000
    clean, planted = op9_toxicity.Scorer(model).scores([long, long + "vileful vileness grossly"])
    assert planted > clean


def plain_score(model, text):
    """The model's score by a loop over words, filters and places."""
    words = text.split()
    rows = [np.frombuffer(op9_toxicity.buckets_of(w), "<u2") for w in words]
    vectors = [model.vectors[r].sum(0) for r in rows] + [np.zeros(op9_toxicity.DIM)] * 4
    pooled = []
    for width, filters in zip(op9_toxicity.WIDTHS, model.filters, strict=True):
        for k in range(op9_toxicity.FILTERS):
            pooled.append(max(sum(float(vectors[at + o] @ filters[o][:, k]) for o in range(width)) for at in range(len(words) + 2)))
    z = sum(max(0.0, p + float(b)) * float(o) for p, b, o in zip(pooled, model.bias, model.out, strict=True)) + model.const
    tongue = op9_toxicity.language({w.lower() for w in words})
    return 1 / (1 + math.exp(-max(-30, min(30, z - model.thresholds.get(tongue, model.thresholds["other"])))))


def test_scores_equal_a_plain_convolution(monkeypatch):
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["nice", "day", "the", "of", "calm", "sea", "idiot", "awful"][: 6 if k % 2 else 8]) for _ in range(rng.randint(0, 40))) for k in range(120)]
    model = op9_toxicity.train(texts, [int("idiot" in t) for t in texts], 1.0)
    got = op9_toxicity.Scorer(model).scores(texts)
    assert np.allclose(got, [plain_score(model, t) for t in texts], atol=1e-4)
    monkeypatch.setattr(op9_toxicity, "STEP_WORDS", 7)
    assert np.allclose(got, op9_toxicity.Scorer(model).scores(texts), atol=1e-4)
    sliced = op9_toxicity.train(texts, [int("idiot" in t) for t in texts], 1.0)
    assert np.allclose(sliced.vectors, model.vectors, atol=1e-3)


def test_toxicity_of_awkward_rows(spark, awkward, empty):
    docs = awkward.select("doc_id", "text", "score")
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    model = op9_toxicity.fit_model(docs, labels)
    got = op9_toxicity.score(docs, model).collect()
    assert len(got) == awkward.count() and all(0 <= r["score"] <= 1 for r in got)
    equal = {r["score"] for r in got if r["row"]["doc_id"] in (6, 7)}
    assert len(equal) == 1 and got[0]["row"]["score"] == "score"
    none = op9_toxicity.fit_model(docs, labels.limit(0))
    assert {r["score"] for r in op9_toxicity.score(docs, none).collect()} == {0.0}
    assert op9_toxicity.score(empty.select("doc_id", "text"), model).count() == 0


def test_held_out_rows_never_train(spark):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(50)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id long, toxic int")
    seen = labels.where("crc32(cast(doc_id as string)) % 5 != 0").count()
    assert seen == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(50)) < 50
    assert op9_toxicity.fit_model(docs, labels).prior is None


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "substring_dedup", "packing"]
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        following = stage(spark, now, SF)
        assert following.columns == docs.columns, name
        assert 0 < following.count() <= now.count()
        now = following
    texts = {r["doc_id"] for r in now.select("doc_id").collect()}
    pieces = corpus_pipeline.STAGES[-1][1](spark, now, SF)
    assert {r["doc_id"] for r in pieces.select("doc_id").collect()} == texts
    assert corpus_pipeline.run(spark, SF).count() == pieces.count()
