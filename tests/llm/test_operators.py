"""Each corpus operator against brute force, and on odd and empty tables."""

import base64
import hashlib
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from orrery.llm import bpe, common, fingerprint, licenses, line_dedup, mixing, ngram_join, quality, sharding, warc, webp
from orrery.llm.common import components, saved, work_path
from tests.llm.conftest import LONG, ROWS

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


def brute_components(texts, words, percent):
    sets = {}
    for i, t in texts:
        w = re.findall(rb"[^\x20\x09-\x0d]+", bytes(b + 32 if 65 <= b <= 90 else b for b in (t or "").encode()))
        sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_components(spark):
    edges = [(i, i + 1) for i in range(100, 120)] + [(5, 9), (9, 7), (7, 5), (3, 3), (1, 200), (200, 150), (None, 4)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**dict.fromkeys(range(100, 121), 100), 5: 5, 7: 5, 9: 5, 1: 1, 150: 1, 200: 1}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_ngram_join_equals_brute_force_with_a_hub(spark, odd, none):
    base = [f"w{i}" for i in range(120)]
    star = [(100, " ".join(base))] + [(101 + k, " ".join("x%d" % k if i // 3 == 3 * k else w for i, w in enumerate(base))) for k in range(12)]
    texts = star + [(r[0], r[1]) for r in ROWS if r[0] is not None]
    df = spark.createDataFrame(texts, "doc_id bigint, text string")
    for words, percent in ((4, 85), (5, 80)):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_jaccard_components(df, words=words, percent=percent).collect()}
        assert got == brute_components(texts, words, percent)
    assert ngram_join.ngram_jaccard_components(odd).count() == odd.count()
    assert ngram_join.ngram_jaccard_components(none).count() == 0
    kept = Counter(r["doc_id"] for r in ngram_join.one_of_each_group(odd).collect())
    assert kept == Counter([0, 2, 3, 4, 5, None, 7, 8])


def test_ngram_join_moves_its_postings_once(spark, tmp_path):
    rows = [(k, i, 5) for k in range(50) for i in range(k % 3 + 1)] * 2
    spark.createDataFrame(rows, "key long, id long, n long").write.parquet(f"{tmp_path}/posts")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        live = ngram_join._live(spark.read.parquet(f"{tmp_path}/posts"))
        got = sorted(map(tuple, live.collect()))
        plan = live._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == sorted({r for r in rows if r[0] % 3})
    moved = [x for x in plan.splitlines() if re.match(r"[ :+-]*Exchange ", x)]
    assert len(moved) == 1 and "ReusedExchange" in plan


def test_ngram_join_with_several_hubs_in_a_bucket(spark):
    rng = np.random.default_rng(4)
    shared = [f"s{i}" for i in range(90)]  # a passage in every text: all meet in the same buckets
    texts, of = [], {}
    for hub in range(4):
        own = [f"h{hub}x{i}" for i in range(0, 30 + 8 * hub)]
        for _ in range(14):  # variants of a hub, some within the threshold of it, some of each other only
            w = shared + own
            for at in rng.choice(len(w), int(rng.integers(0, 5)), replace=False):
                w[at] = f"e{int(rng.integers(0, 6))}"
            of[len(texts)] = hub
            texts.append((len(texts) * 3, " ".join(w)))
    df = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(5)
    for words, percent in ((4, 85), (5, 80)):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_jaccard_components(df, words=words, percent=percent).collect()}
        want = brute_components(texts, words, percent)
        assert got == want and len({c for _, c in want.values()}) > 4


def test_one_of_each_group_with_repeated_ids(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    near = a.replace("a59", "z")
    rows = [(1, a), (2, near), (2, b), (3, b), (4, "alone"), (4, "alone"), (5, a), (5, near), (None, a), (6, None), (6, None), (7, " ")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id bigint, text string, text_hash int, n int")
    got = Counter((r["doc_id"], r["text"]) for r in ngram_join.one_of_each_group(df).collect())
    assert got == Counter([(1, a), (2, b), (4, "alone"), (None, a), (6, None), (6, None), (7, " ")])


def test_warc_round_trip(spark, none):
    pages = [(5, "u\r\nx", "same" * 50000), (3, None, "same" * 50000), (9, "v", "same" * 50000), (1, "q", None), (2, "q", ""), (4, "q", "héllo\r\n\r\nWARC/1.1"), (None, "z", "no id")]
    df = spark.createDataFrame([(*p, 1) for p in pages], "page_id bigint, url string, html string, payload int")
    table = warc.read_archives(warc.write_archives(warc.with_revisits(df), work_path(spark, "w"))).collect()
    last = {r["page_id"]: r for r in table if r["last"]}
    first = {}
    for i, _, h in sorted((p for p in pages if p[0] is not None)):
        h = (h or "").encode()
        first.setdefault(h, i)
        want = (len(h), base64.b32encode(hashlib.sha1(h).digest()).decode(), "response" if first[h] == i else "revisit", None if first[h] == i else first[h])
        assert (last[i]["payload_bytes"], last[i]["payload_digest"], last[i]["record_type"], last[i]["refers_to"]) == want
        assert last[i]["stated_digest"] == want[1]
    body = b"".join(bytes(r["data"]) for r in sorted((r for r in table if r["page_id"] == 3), key=lambda r: r["chunk"]))
    assert body == b"same" * 50000 and len([r for r in table if r["page_id"] == 3]) == 4 and last[None]["record_type"] == "response"
    empty = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert warc.read_archives(warc.write_archives(warc.with_revisits(empty), work_path(spark, "w"))).count() == 0
    with pytest.raises(ValueError):
        import io

        list(warc.record_chunks(io.BytesIO(zlib.compress(b"WARC/1.1\r\nContent-Length: 9\r\n", wbits=31))))


def test_quality_on_held_out_rows(spark, docs, odd, none):
    labels, larger = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("labels", "documents"))
    model = quality.train(larger, labels)
    got = quality.score(larger, model).join(labels, "doc_id").where(quality.held_out(F.col("doc_id"))).toPandas()
    assert (got["predicted"] == got["quality"]).mean() > 0.93
    assert len(quality.score(odd, model).collect()) == len(ROWS) and quality.score(none, model).count() == 0
    data = np.frombuffer(LONG.encode() * 3, np.uint8)
    long = model.score(data, np.array([0, len(data)]))[0]  # in pieces of bounded size
    sums, n = model._long(data)
    assert 0 <= long <= 1 and n == -(-len(data) // quality.BLOCK) - 1
    both = model.score(np.concatenate([data[:5000], data[:700]]), np.array([0, 5000, 5700, 5700]))
    assert both[0] == pytest.approx(model.score(data[:5000], np.array([0, 5000]))[0]) and len(both) == 3
    assert quality.train(docs, labels.where("false")).score(data, np.array([0, 0, 9])).shape == (2,)


def test_quality_scores_by_brute_force_alone_and_in_any_batch():
    rng = np.random.default_rng(2)
    texts = [bytes(rng.integers(0, 256, int(n), dtype=np.uint8)) for n in (0, 1, 3, 511, 512, 513, 1024, 1025, 3000, quality.KERNEL_BYTES + 700)]
    model = quality.ByteCNN(rng.normal(0, 0.3, (quality.WIDTH, 256, quality.FILTERS)).astype(np.float32), rng.normal(0, 0.1, quality.FILTERS).astype(np.float32), rng.normal(0, 0.4, quality.FILTERS), 0.1)

    def plain(t):
        t = t or b"\0"
        padded = np.frombuffer(t + b"\0" * (quality.WIDTH - 1), np.uint8)
        r = np.array([sum(model.filters[k][padded[i + k]] for k in range(quality.WIDTH)) for i in range(len(t))]) + model.bias
        blocks = [np.maximum(r[a : a + quality.BLOCK].max(0), 0) for a in range(0, len(t), quality.BLOCK)]
        chunks = [np.maximum(x, y) for x, y in zip(blocks, blocks[1:], strict=False)] or blocks
        return 1 / (1 + np.exp(-(np.mean(chunks, 0) @ model.weights + model.offset)))

    at = np.cumsum([0, *map(len, texts)])
    data = np.frombuffer(b"".join(texts), np.uint8)
    together = model.score(data, at)
    assert together == pytest.approx([plain(t) for t in texts], abs=1e-5)
    alone = [model.score(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0] for t in texts]
    halves = np.concatenate([model.score(data[at[i] : at[j]], at[i : j + 1] - at[i]) for i, j in ((0, 4), (4, len(texts)))])
    assert together.tolist() == alone == halves.tolist()


def test_quality_trains_on_long_documents(spark):
    long = "".join(chr(97 + i // 5000) for i in range(100_000))
    df = spark.createDataFrame([("short",), (long,)], "text string").select(quality._spread(F.col("text").cast("binary")).alias("t"))
    got = [bytes(r["t"]) for r in df.collect()]
    assert got[0] == b"short" and len(got[1]) == quality.SAMPLE_BYTES and set(got[1]) == set(long.encode()) and got[1][-512:] == long.encode()[-512:]


def test_hilbert_order_by_brute_force(spark):
    rng = np.random.default_rng(8)
    rows = [(i, "x" * int(rng.integers(0, 300)), [None, "https://a.example/1", "https://a.example/2", "https://b.example", "z"][i % 5], ["en", None, "fr"][i % 3]) for i in range(700)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string").repartition(4)
    got = sharding.hilbert_shards(df, 7, bucket_rows=50).collect()
    n, side = len(rows), 1 << sharding.BITS

    def level(values):
        order = Counter(values)
        out, before = {}, 0
        for v in sorted(order, key=lambda x: (x is not None, (x or "").encode())):
            out[v] = min(side - 1, int((before + order[v] / 2) * side // n))
            before += order[v]
        return out

    source, lang = level([r[2] for r in rows]), level([r[3] for r in rows])
    sizes = sorted(len(r[1]) + 16 for r in rows)
    cuts = sorted({sizes[max(0, -(-n * i // side) - 1)] for i in range(1, side)})
    cell = {r[0]: sharding.hilbert_index((source[r[2]], lang[r[3]], sum(len(r[1]) + 16 >= c for c in cuts)), sharding.BITS) for r in rows}
    assert {r["doc_id"]: r["cell"] for r in got} == cell
    order = [r["cell"] for r in sorted(got, key=lambda r: (r["shard"], r["slot"]))]
    assert order == sorted(order)  # shards are runs of the curve, and slots follow it
    assert len({source[s] for s in ("https://a.example/1", "https://a.example/2")}) == 2


def test_hilbert_shards(spark, odd, none, tmp_path):
    cells = {sharding.hilbert_index((x, y, z), 2): (x, y, z) for x in range(4) for y in range(4) for z in range(4)}
    assert sorted(cells) == list(range(64))
    assert all(sum(abs(a - b) for a, b in zip(cells[i], cells[i + 1], strict=True)) == 1 for i in range(63))
    many = odd.crossJoin(spark.range(9).withColumnRenamed("id", "copy"))
    for df, bucket in ((odd, 20000), (many, 4)):
        rows = sharding.hilbert_shards(df, 5, bucket).collect()
        slots = defaultdict(list)
        for r in rows:
            slots[r["shard"]].append(r["slot"])
        sizes = [len(v) for v in slots.values()]
        assert max(sizes) - min(sizes) <= 1 and len(rows) == df.count() and all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert {(r["doc_id"], r["size"], r["text_crc32"]) for r in rows} == {(r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in ROWS}
    assert sharding.hilbert_shards(none).count() == 0
    sharding.write_shards(odd.where("doc_id not in (1)"), sharding.hilbert_shards(odd.where("doc_id not in (1)"), 3), f"file://{tmp_path}/sh")
    assert spark.read.parquet(f"file://{tmp_path}/sh").count() == 9


def test_mix_meets_targets(spark, docs, odd, none):
    rows = mixing.plan_mix(docs, bucket_rows=7).toPandas()
    words = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0d]+", r["text"] or "")) for r in docs.collect()}
    assert dict(zip(rows["doc_id"], rows["size"], strict=True)) == words and (rows["taken"] <= 3 * rows["size"]).all()
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    rows["source"] = rows["doc_id"].map(source)
    names, total = sorted(set(source.values())), rows["size"].sum()
    sizes = rows.groupby("source")["size"].sum().to_dict()
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, set(names), float(total)
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
            free.discard(s)
    for s, g in rows.groupby("source"):
        assert g["target"].iloc[0] == pytest.approx(target[s]) and g["taken"].sum() == int(g["target"].iloc[0] + 1e-9)
    again = mixing.plan_mix(docs, bucket_rows=7).toPandas()
    assert again.sort_values("doc_id")["taken"].tolist() == rows.sort_values("doc_id")["taken"].tolist()
    assert all(0 <= p < 1 for ps in rows["positions"] for p in ps)
    assert mixing.plan_mix(odd).count() == len(ROWS) and mixing.plan_mix(none).count() == 0 and mixing.mixed(none).count() == 0
    assert set(mixing.mixed(odd).columns) == {*odd.columns, "position"}
    same = spark.createDataFrame([(1, "a b c", "s", "kept")] * 3 + [(2, "d e", "s", "too")], "doc_id bigint, text string, source string, row string")
    rows, plan = mixing.mixed(same).collect(), mixing.plan_mix(same).collect()
    assert Counter(r["row"] for r in rows) == {"kept": sum(len(p["positions"]) for p in plan if p["doc_id"] == 1), "too": sum(len(p["positions"]) for p in plan if p["doc_id"] == 2)}
    assert sorted(r["position"] for r in rows) == sorted(x for p in plan for x in p["positions"]) == [r["position"] for r in rows]


def test_positions_invert_the_demand(spark):
    knots = ((0.0, 1.0), (0.25, 3.0), (1.0, 0.0))
    t, w, _ = mixing._demand(knots)
    shares = [i / 50 for i in range(50)]
    df = spark.createDataFrame([(s,) for s in shares], "s double")
    for r in df.select("s", mixing.position(F.lit(0), F.col("s"), (knots,)).alias("t")).collect():
        grid = np.linspace(0, r["t"], 4001)
        assert np.trapezoid(np.interp(grid, t, w), grid) == pytest.approx(r["s"], abs=1e-4)


def test_line_dedup(spark, odd, none):
    line = "thirteen words stand in this line so that one may well be changed"
    docs = [(0, f"{line}\nonly here and nowhere else at all"), (1, f"{line.upper()}  \n\nblank lines stay where they are"), (2, line.replace("stand", "sit")), (3, "something entirely different with as many words as the others have here"), (4, None), (5, "short\nshort"), (6, "")]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id bigint, text string, n_lines int")
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed"]) for r in line_dedup.dedup_lines(df).collect()}
    assert got == {0: (docs[0][1], 2, 0), 1: ("\nblank lines stay where they are", 3, 1), 2: ("", 1, 1), 3: (docs[3][1], 1, 0), 4: (None, 0, 0), 5: ("short\nshort", 2, 0), 6: ("", 1, 0)}
    out = line_dedup.dedup_lines(odd)
    assert out.count() == len(ROWS) and line_dedup.dedup_lines(none).count() == 0


def test_line_dedup_takes_short_lines_and_leaves_no_residue(spark, tmp_path):
    import corpus_pipeline

    docs = [(0, "les.\nund äbe.\na longer line that both of the copies hold"), (1, "Les.\n\n und äbe.\n\na longer line that both of the copies hold"), (2, "les.\n你好。"), (3, "你好。\nx"), (4, "\n \n"), (5, "ab\nac")]
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in line_dedup.query(spark, str(tmp_path)).collect()}
    assert got == {0: (docs[0][1], 0), 1: ("\n", 3), 2: ("你好。", 1), 3: ("x", 1), 4: ("\n \n", 0), 5: ("ab\nac", 0)}
    kept = corpus_pipeline._line_dedup(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), None)
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 2, 3, 4, 5]


def test_line_dedup_finds_what_brute_force_links(docs):
    lines = [(r["doc_id"], i, x.strip().lower()) for r in docs.collect() for i, x in enumerate((r["text"] or "").split("\n")) if len(x.strip()) >= 16]
    sets = {x: {x[k : k + 4] for k in range(len(x) - 3)} for _, _, x in lines}
    keys, root = sorted(sets), {x: x for x in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            small, large = sorted((len(sets[a]), len(sets[b])))
            if 100 * small >= 80 * large and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                root[find(b)] = find(a)
    first = {}
    for d, i, x in sorted(lines):
        first.setdefault(find(x), (d, i))
    want = {(d, i) for d, i, x in lines if first[find(x)] != (d, i)}
    got = {(r["doc_id"], r["pos"]) for r in line_dedup.duplicate_lines(docs).collect()}
    assert len(got & want) >= 0.99 * len(want) and got <= want


@pytest.mark.parametrize("first,letters,space", [(0x430, 32, " "), (0x3B1, 24, " "), (0x5D0, 27, " "), (0x905, 48, " "), (0x4E00, 300, "")])
def test_line_dedup_keeps_unrelated_lines_of_any_script(spark, first, letters, space):
    rng = np.random.default_rng(9)
    lines = [space.join("".join(chr(first + int(c)) for c in rng.integers(0, letters, 7)) for _ in range(80)) for _ in range(30)]
    edited = lines[0][:100] + chr(first) * 3 + lines[0][103:]
    df = spark.createDataFrame([*enumerate(lines), (99, edited)], "doc_id bigint, text string")
    assert [(r["doc_id"], r["keep_doc"]) for r in line_dedup.duplicate_lines(df).collect()] == [(99, 0)]


def test_line_dedup_compares_every_character(spark):
    docs = [
        (0, "https://www.first-site.com/about/contact"),
        (1, "https://www.other-place.org/shop/item-77"),
        (2, "internationalisation characterisation"),
        (3, "international characters"),
        (4, "seven quite ordinary words with one typographical mistake"),
        (5, "seven quite ordinary words with one typographicel mistake"),
    ]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert [(r["doc_id"], r["keep_doc"]) for r in line_dedup.duplicate_lines(df).collect()] == [(5, 4)]


def test_line_dedup_recall_of_lines_that_differ(spark):
    rng = np.random.default_rng(11)
    grams = lambda x: {x[i : i + 4] for i in range(len(x) - 3)}
    docs, pairs = [], {True: [], False: []}
    while len(docs) < 3000:  # edited lines of 16 to 300 characters, likenesses of 0.8 to 0.87
        a = " ".join("".join(map(chr, rng.integers(97, 123, int(rng.integers(2, 9))))) for _ in range(60))[: int(np.exp(rng.uniform(2.8, 5.7 if len(docs) % 4 else 3.4)))].strip()
        b = a
        for _ in range(int(rng.integers(1, 8))):
            at = int(rng.integers(0, len(b) + 1))
            b = b[:at] + chr(int(rng.integers(97, 123))) + b[at + int(rng.integers(0, 2)) :]
        x, y = grams(a), grams(b)
        if a != b and 0.8 <= len(x & y) / len(x | y) <= 0.87:
            docs += [(len(docs), a), (len(docs) + 1, b)]
            pairs[max(len(x), len(y)) <= 30].append(docs[-1][0])
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = {(r["doc_id"], r["keep_doc"]) for r in line_dedup.duplicate_lines(df, min_chars=1).collect()}
    found = {short: np.mean([(d, d - 1) in got for d in ds]) for short, ds in pairs.items()}
    assert min(map(len, pairs.values())) > 50 and found[True] == 1 and found[False] >= 0.99


def test_line_dedup_recall_of_long_lines(spark):
    rng = np.random.default_rng(12)
    docs = []
    while len(docs) < 1200:  # edits far apart in lines of 80 to 2,000 characters, likenesses of 0.8 to 0.84
        a = " ".join("".join(map(chr, rng.integers(97, 123, int(rng.integers(2, 9))))) for _ in range(420))[: int(np.exp(rng.uniform(4.4, 7.6)))].strip()
        b, n = list(a), max(1, int(len(a) * 0.026))
        for at in rng.choice(len(a) // 9, n, replace=False) * 9:
            b[at] = chr(int(rng.integers(97, 123)))
        b = "".join(b)
        x, y = ({t[i : i + 4] for i in range(len(t) - 3)} for t in (a, b))
        if 0.8 <= len(x & y) / len(x | y) <= 0.84:
            docs += [(len(docs), a), (len(docs) + 1, b)]
    got = {(r["doc_id"], r["keep_doc"]) for r in line_dedup.duplicate_lines(spark.createDataFrame(docs, "doc_id bigint, text string"), min_chars=1).collect()}
    assert got <= {(i + 1, i) for i in range(0, 1200, 2)} and len(got) >= 0.98 * 600


def test_line_dedup_of_lines_of_few_different_runs(spark):
    docs = [(0, "-" * 100), (1, "-" * 3000), (2, "ab" * 400), (3, "ba" * 390), (4, "=" * 90), (5, "-"), (6, "--")]
    got = {(r["doc_id"], r["keep_doc"]) for r in line_dedup.duplicate_lines(spark.createDataFrame(docs, "doc_id bigint, text string"), min_chars=1).collect()}
    assert got == {(1, 0), (3, 2)}


def test_line_dedup_second_round_loses_no_link(spark):
    rng = np.random.default_rng(5)
    centre = set(range(1000, 1050))
    sets = {0: centre}
    for i in range(1, 160):  # variants of one line at all distances, some of them variants of each other
        of = sets[int(rng.integers(0, i))] if i % 3 == 0 else centre
        out = set(rng.choice(sorted(of), int(rng.integers(0, 12)), replace=False).tolist())
        sets[i] = (of - out) | set(rng.integers(0, 400, int(rng.integers(0, 12))).tolist())
    linked = lambda a, b: 100 * len(a & b) >= 80 * len(a | b)
    comp = {i: 0 if linked(s, centre) else i for i, s in sets.items()}
    live = spark.createDataFrame([(1, i, len(s)) for i, s in sets.items()], "key long, id long, n long")
    heads = spark.createDataFrame([(1, 0, 50)], "key long, lead long, ln long")
    parts = spark.createDataFrame(list(comp.items()), "id long, component long")
    frame = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "id long, s array<long>")
    got = {(r["a"], r["b"]) for r in line_dedup._unconnected(line_dedup._apart(live, heads, parts), frame, 80).collect()}
    between = {(i, j) for i in sets for j in sets if 0 < i < j and comp[i] != comp[j]}
    links = {(i, j) for i, j in between if linked(sets[i], sets[j])}
    assert links and links <= got and len(got) < len(between) / 4


def test_line_dedup_second_round_lets_out_what_may_be_linked_only(spark):
    rng = np.random.default_rng(6)
    words = ["".join(map(chr, rng.integers(97, 107, 4))) for _ in range(200)]  # unrelated lines share many runs
    lines = [" ".join(rng.choice(words, 60)) for _ in range(60)]
    lines += [x[:150] + "#" + x[151:] for x in lines[:20]] + ["ab", "abc", "中文" * 40, "中文" * 39 + "字", "😀" * 30 + "x", "😀" * 31 + "x"]
    sets = [{x[i : i + 4] for i in range(max(1, len(x) - 3))} for x in lines]
    links = {(i, j) for j in range(len(sets)) for i in range(j) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    apart = spark.createDataFrame([(-1, i, 0 if i < 10 else i) for i in range(len(lines))], "lead long, id long, c long")
    texts = spark.createDataFrame(list(enumerate(lines)), "id long, s string")
    got = {(r["a"], r["b"]) for r in line_dedup._unconnected(apart, texts, 80, lambda s: line_dedup._grams(s, 4)).collect()}
    assert len(links) >= 21 and {(i, j) for i, j in links if j >= 10} <= got and all(j >= 60 for _, j in got)


def test_line_dedup_second_round_tells_long_lines_apart_that_share_much(spark):
    rng = np.random.default_rng(8)
    base = rng.integers(97, 123, 800)
    lines = []
    for i in range(40):  # edits far apart, of which two lines share few: similarities of 0.6 to 0.77, and two links
        at = rng.choice(200, 15 + i % 6, replace=False) * 4
        line = base.copy()
        line[at] = rng.integers(65, 91, len(at))
        lines.append("".join(map(chr, line)))
    lines += [lines[0] + " and a tail", "x" + lines[1]]
    sets = [{x[i : i + 4] for i in range(len(x) - 3)} for x in lines]
    like = {(i, j): len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for j in range(len(sets)) for i in range(j)}
    apart = spark.createDataFrame([(-1, i, i) for i in range(len(lines))], "lead long, id long, c long")
    texts = spark.createDataFrame(list(enumerate(lines)), "id long, s string")
    got = {(r["a"], r["b"]) for r in line_dedup._unconnected(apart, texts, 80, lambda s: line_dedup._grams(s, 4)).collect()}
    links = {k for k, x in like.items() if x >= 0.8}
    assert links and links <= got
    assert sum(x < 0.76 for x in like.values()) > 300 and not any(like[k] < 0.76 for k in got)


def test_line_dedup_splits_documents_once_and_makes_nothing_anew_in_lambdas(spark, monkeypatch):
    plans, kept = [], line_dedup.saved
    monkeypatch.setattr(line_dedup, "saved", lambda df, name: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), kept(df, name))[1])
    line = "a line that is long enough to have runs, number "
    docs = spark.createDataFrame([(i, f"{line}{i}\nthe other one of a document, unlike the first: {i}") for i in range(12)], "doc_id bigint, text string")
    assert line_dedup.duplicate_lines(docs).count() == 22
    assert sum("split(" in plan for plan in plans) == 1

    def inside(e, lambdas=()):
        name = e.nodeName()
        out = [name] if lambdas else []
        for i in range(e.children().size()):
            out += inside(e.children().apply(i), (*lambdas, name) if name == "LambdaFunction" else lambdas)
        return out

    df = spark.createDataFrame([(1, [1, 2, 3, 4], 4)], "id bigint, s array<bigint>, n int").withColumn("line", F.lit("abcdef"))
    project = lambda c: df.select(c.alias("x"))._jdf.queryExecution().analyzed().expressions().apply(0)
    shingles, bands = inside(project(line_dedup._shingles("line"))), inside(project(line_dedup._bands("s", "n", 80)))
    assert "XxHash64" in shingles and "XxHash64" in bands  # hashes are made in lambdas
    assert "ArrayDistinct" not in shingles and "Concat" not in bands


def test_saved_leaves_no_shuffle_files(spark):
    def files():
        held = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {n for i in range(held.size()) if (n := held.apply(i).getName()).startswith("shuffle_")}

    before = files()
    out = saved(spark.range(1000).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).count(), "cleanup")
    for _ in range(50):
        if not files() - before:
            break
        time.sleep(0.2)
    assert not files() - before and out.count() == 7
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_webp_round_trip_and_transforms(spark, odd, none):
    payloads = [(r[1] or "").encode() for r in ROWS] + [bytes(range(256)) * 3, b"\xff" * 192]
    payloads = [p + b" " * ((-len(p)) % 192 if p else 192) for p in payloads] * 3
    media = webp.encode_grey(payloads)
    assert webp.decode_grey(media) == payloads  # enough streams for decoding in step
    for m, p in zip(media[:4], payloads, strict=False):
        width, _, px = webp.decode_stream(webp.images(m)[0])
        assert width == 192 and ((px >> 16) & 255).astype(np.uint8).tobytes() == p
    with pytest.raises(ValueError):
        webp.decode_grey([media[0][:40]])
    for cut in (1, 2, 8, 60):  # in a batch, of streams of all lengths, the last one too
        for k in (0, 5, len(media) - 1):
            riff = bytearray(media[k])
            if (n := int.from_bytes(riff[16:20], "little") - cut) < 8:
                continue
            short = bytes(riff[:4]) + (12 + n + (n & 1)).to_bytes(4, "little") + b"WEBPVP8L" + n.to_bytes(4, "little") + bytes(riff[20 : 20 + n]) + b"\0" * (n & 1)
            with pytest.raises(ValueError):
                webp.decode_grey([*media[:k], short, *media[k + 1 :]])
    got = webp.from_media(webp.to_media(odd)).collect()
    for r, row in zip(got, ROWS, strict=True):
        p = (row[1] or "").encode()
        p += b" " * ((-len(p)) % 192 if p else 192)
        assert (bytes(r["payload"]), r["payload_sha256"], r["tail_crc32"]) == (p, hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
    assert webp.from_media(webp.to_media(none)).count() == 0


def test_webp_back_references_of_the_encoder():
    rng = np.random.default_rng(6)
    line = bytes(rng.integers(97, 123, 150, dtype=np.uint8)) + b"\n"
    random = bytes(rng.integers(0, 256, 700, dtype=np.uint8))
    payloads = [b"=" * 192, b" " * 3840, line * 40, (line + b"x" * 9) * 300 + random, random * 30, b"ab" * 4000, line * 9000, random]
    payloads = [p + b" " * (-len(p) % 192) for p in payloads]
    media = webp.encode_grey(payloads)
    assert webp.decode_grey(media) == payloads
    general = [any(webp._literal(x) is None for x in webp.images(m)) for m in media]
    assert general[1:7] == [True] * 6 and not general[7] and all(len(m) < len(p) / 4 for m, p in zip(media[1:4], payloads[1:4], strict=True))
    for p in payloads[:6]:
        tokens = webp._repeats(p)
        out = bytearray()
        for n, x in tokens:
            out += bytes([x]) if n < 0 else b""
            for _ in range(max(n, 0)):
                out.append(out[-x])
        assert bytes(out) == p and all(n < 0 or 16 <= n <= 4096 for n, _ in tokens)
    for v in (*range(1, 70), 4096, 1 << 20):
        symbol, extra, width = webp._prefix(v)
        w = webp.BitWriter()
        w.put(extra, width), w.put(0, 8)
        assert webp._value(symbol, webp.Bits(w.bytes())) == v
    assert max(webp._code_lengths([2**i for i in range(40)])) <= 15


def simple(w, *symbols):
    """A prefix code of one or two symbols."""
    w.put(1, 1), w.put(len(symbols) - 1, 1), w.put(1, 1)
    for s in symbols:
        w.put(s, 8)


def start(width, height):
    w = webp.BitWriter()
    w.put(0x2F, 8), w.put(width - 1, 14), w.put(height - 1, 14), w.put(0, 4)
    return w


def plain(w, *argb, main=False):
    """An entropy-coded image of one colour."""
    w.put(0, 1)
    if main:
        w.put(0, 1)
    for s in (argb[2], argb[1], argb[3], argb[0], 0):
        simple(w, s)


def test_webp_predictor_cross_colour_and_palette():
    w = start(4, 3)  # every predictor adds 1 to a neighbour: rows and columns grow from the corner
    w.put(1, 1), w.put(0, 2), w.put(0, 3)
    plain(w, 255, 0, 1, 0)  # mode 1: left
    w.put(0, 1)
    plain(w, 0, 0, 1, 0, main=True)
    _, _, p = webp.decode_stream(w.bytes())
    assert (p >> 8 & 255).reshape(3, 4).tolist() == [[1, 2, 3, 4], [2, 3, 4, 5], [3, 4, 5, 6]] and set((p >> 24).tolist()) == {255}
    w = start(2, 1)
    w.put(1, 1), w.put(1, 2), w.put(0, 3)
    plain(w, 255, 32, 64, 224)  # red to blue 32, green to blue 64, green to red -32
    w.put(0, 1)
    plain(w, 255, 10, 20, 30, main=True)
    _, _, p = webp.decode_stream(w.bytes())
    red = (10 + (-32 * 20 >> 5)) & 255
    assert p.tolist() == [255 << 24 | red << 16 | 20 << 8 | (30 + (64 * 20 >> 5) + (32 * ((red ^ 128) - 128) >> 5)) & 255] * 2
    w = start(8, 1)  # a palette of two colours: eight pixels in a byte
    w.put(1, 1), w.put(3, 2), w.put(1, 8)
    w.put(0, 1)
    for _ in range(1):
        simple(w, 7), simple(w, 0), simple(w, 0), simple(w, 255), simple(w, 0)
    w.put(0, 1)
    plain(w, 0, 0, 0b10110010, 0, main=True)
    _, _, p = webp.decode_stream(w.bytes())
    assert [(x >> 8) & 255 for x in p.tolist()] == [14 if 0b10110010 >> i & 1 else 7 for i in range(8)]


@pytest.mark.parametrize("mode", range(14))
def test_webp_predictor_modes_against_a_plain_form(mode):
    rng, width, height = np.random.default_rng(mode), 5, 4
    rest = rng.integers(0, 256, (height * width, 4))
    got = webp._channels(webp._unpredict(webp._joined(rest), width, height, 2, np.full(2, mode << 8, np.uint32)))
    out = np.zeros((height * width, 4), int)
    for i in range(len(out)):
        x, y = i % width, i // width
        for c in range(4):
            if x and y:
                left, top, corner, right = (int(out[j, c]) for j in (i - 1, i - width, i - width - 1, i - width + 1))
                a = lambda u, v: (u + v) // 2
                if mode == 11:
                    pl = sum(abs(int(out[i - 1, k]) + int(out[i - width, k]) - int(out[i - width - 1, k]) - int(out[i - 1, k])) for k in range(4))
                    pt = sum(abs(int(out[i - 1, k]) + int(out[i - width, k]) - int(out[i - width - 1, k]) - int(out[i - width, k])) for k in range(4))
                    g = left if pl < pt else top
                else:
                    g = [255 if c == 0 else 0, left, top, right, corner, a(a(left, right), top), a(left, corner), a(left, top), a(corner, top), a(top, right), a(a(left, corner), a(top, right)), 0, max(0, min(255, left + top - corner)), max(0, min(255, a(left, top) + int((a(left, top) - corner) / 2)))][mode]
            else:
                g = int(out[i - 1, c]) if x else int(out[i - width, c]) if y else (255 if c == 0 else 0)
            out[i, c] = (int(rest[i, c]) + g) % 256
    assert (got == out).all()


def test_webp_back_references_and_colour_cache():
    w = start(6, 1)
    w.put(0, 1)  # no transform
    w.put(1, 1), w.put(1, 4)  # a colour cache of two colours
    w.put(0, 1)
    # Green: 5 (2 bits), length of one and cache colours, in code lengths written out one by one.
    used = {5: 2, 256: 2, 280: 2, 281: 2}
    w.put(0, 1), w.put(14 - 4 + 4, 4)
    kinds = {2: 1, 0: 2, 18: 2}
    for k in webp.LENGTH_ORDER[:18]:
        w.put(kinds.get(k, 0), 3)
    w.put(0, 1)
    codes = {s: (c, n) for (n, c), s in webp.canonical([kinds.get(i, 0) for i in range(19)]).items()}

    def zeros(n):
        while n >= 11:
            w.put(*codes[18]), w.put(min(n, 138) - 11, 7)
            n -= min(n, 138)
        for _ in range(n):
            w.put(*codes[0])

    at = 0
    for s in sorted(used):
        zeros(s - at)
        w.put(*codes[2])
        at = s + 1
    zeros(282 - at)
    for s in (0, 0, 255, 1):  # red, blue, alpha; distance code 1 has no extra bits: neighbour (1, 0)
        simple(w, s)
    green = {s: (c, n) for (n, c), s in webp.canonical([used.get(i, 0) for i in range(282)]).items()}
    colour = 255 << 24 | 5 << 8
    slot = (0x1E35A7BD * colour & 0xFFFFFFFF) >> 31
    for s in (5, 256, 280 + slot, 256, 5, 280 + slot):
        w.put(*green[s])
    assert webp.decode_stream(w.bytes())[2].tolist() == [colour] * 6


def plain_patience(a, b):
    """How many words a patience alignment may pair: equal ends, then any longest increasing run of the anchors, then its gaps."""
    ends = 0
    while a and b and a[0] == b[0]:
        a, b, ends = a[1:], b[1:], ends + 1
    while a and b and a[-1] == b[-1]:
        a, b, ends = a[:-1], b[:-1], ends + 1
    anchors = sorted((a.index(w), b.index(w)) for w in set(a) & set(b) if a.count(w) == 1 == b.count(w))
    runs = [[]]
    for p in anchors:
        runs += [[*r, p] for r in runs if not r or r[-1][1] < p[1]]
    longest = max(map(len, runs))
    totals = set()
    for run in (r for r in runs if len(r) == longest > 0):
        sums, x, y = {ends + longest}, 0, 0
        for i, j in [*run, (len(a), len(b))]:
            sums = {t + more for t in sums for more in plain_patience(a[x:i], b[y:j])}
            x, y = i + 1, j + 1
        totals |= sums
    return totals or {ends}


def test_licenses(odd, none):
    scanner = licenses.Scanner(licenses.TEMPLATES, 0.9)
    mit = licenses.TEMPLATES["MIT"][2]
    assert [x[:2] for x in scanner.scan("x y " + mit)] == [("MIT", 1.0)]
    got = scanner.scan("the software and the rights " + mit.replace("charge", "cost") + " Released under the MIT License.")
    assert got[0][0] == "MIT" and 0.98 < got[0][1] < 1
    for name, whole in (("MIT", -1), ("ISC", -1), ("BSD-3-Clause", -1), ("BSD-2-Clause", 0)):  # whole licences, one of them in another's clothes
        text = licenses.TEMPLATES[name][whole]
        assert [(x[0], x[2]) for x in scanner.scan(f"Copyright 2020 someone {text} def f(): pass")] == [(name, len(licenses.words_of(text)))]
    assert [x[0] for x in scanner.scan("Licensed under CC BY-NC 4.0.")] == ["CC-BY-NC-4.0"]
    assert scanner.scan("the software is as it is, under the terms of no one") == []
    for a, b in (("abcbdab", "bdcaba"), ("xaybzc", "abc"), ("", "a"), ("aaaa", "aa")):
        pairs = licenses.patience(list(a), list(b))
        assert all(a[i] == b[j] for i, j in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))
    rng = np.random.default_rng(3)
    for _ in range(300):  # by its definition: unique common words, their longest increasing run, the gaps in turn
        a, b = ([str(x) for x in rng.integers(0, 9, int(rng.integers(0, 14)))] for _ in range(2))
        assert len(licenses.patience(a, b)) in plain_patience(a, b)
    assert licenses.scan_licenses(odd).count() == len(ROWS) and licenses.scan_licenses(none).count() == 0


def test_fingerprints(spark, docs, odd, none):
    got = {r["doc_id"]: r for r in fingerprint.edited_fingerprints(docs).collect()}
    texts = sorted((r["doc_id"], r["text"] or "") for r in docs.collect())
    prints = {}
    for i, (d, t) in enumerate(texts):
        k = len(t) // 4
        edited = t[: len(t) - k] + texts[(i + 1) % len(texts)][1][:k]
        assert (got[d]["n_chars"], got[d]["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        prints.setdefault(t, set()).add(got[d]["fingerprint"])
    assert all(len(v) == 1 for v in prints.values()) and len({min(v) for v in prints.values()}) == len(prints)
    assert np.mean([r["near_edited"] for r in got.values()]) > 0.5 > 0.1 > np.mean([r["near_next"] for r in got.values()])
    shuffled = spark.createDataFrame([(1, "a b c\nd e\nf"), (2, "f\na b c\nd e"), (3, "f\na b c\nd  e")], "doc_id bigint, text string")
    p = {r["doc_id"]: r["fingerprint"] for r in fingerprint.fingerprints(shuffled).collect()}
    assert p[1] == p[2] != p[3]
    # Sums: the vector of two paragraphs is that of the one and that of the other, modulo powers.
    v = {r["k"]: r for r in fingerprint.paragraph_vectors(spark.createDataFrame([(0, "a b\nc d e"), (1, "a b"), (2, "c d e")], "k int, text string"), ["k"]).collect()}
    assert all((v[1][c] + v[2][c] - v[0][c]) % 2**32 == 0 for c in v[0].asDict() if c != "k")
    assert fingerprint.edited_fingerprints(odd).count() == len(ROWS) and fingerprint.edited_fingerprints(none).count() == 0


@pytest.mark.parametrize("most_cuts", [500, 2])
def test_fingerprints_find_the_next_document_across_ranges(spark, monkeypatch, most_cuts):
    monkeypatch.setattr(fingerprint, "MOST_CUTS", most_cuts)
    rows = [(i * i, "t%04d " % i * 4) for i in range(0, 500, 7)] + [(-(2**63), "least " * 9), (2**63 - 1, "greatest " * 7), (0, "another zero " * 3), (49, "t0007 " * 4), (49, "t0007 " * 4)]
    df = spark.createDataFrame([*rows, (None, "no id " * 5), (None, "no id " * 5)], "doc_id bigint, text string")
    got = Counter((r["doc_id"], r["edited_sha256"]) for r in fingerprint.edited_fingerprints(df, 5).collect())
    order, want = sorted(set(rows)), Counter()
    for i, (d, t) in enumerate(order):
        k = len(t) // 4
        edited = t[: len(t) - k] + order[(i + 1) % len(order)][1][:k]
        want[d, hashlib.sha256(edited.encode()).hexdigest()] += rows.count((d, t))
    want[None, hashlib.sha256(("no id " * 5)[:23].encode()).hexdigest()] += 2
    assert got == want
    one = spark.createDataFrame([(7, "alone in here")], "doc_id bigint, text string")
    r = fingerprint.edited_fingerprints(one).first()
    assert r["edited_sha256"] == hashlib.sha256(b"alone in halo").hexdigest() and r["near_next"] == 1.0


def test_fingerprints_combine(spark):
    texts = [(1, "a b c\nd e\nf"), (2, "d e"), (3, "a b c\nf"), (4, "f\nd e"), (5, "a b c")]
    df = spark.createDataFrame(texts, "doc_id bigint, text string")
    f = {r["doc_id"]: r["fingerprint"] for r in fingerprint.fingerprints(df).collect()}
    two = spark.createDataFrame([(f[3], f[2], f[1], f[5])], "c string, d string, a string, e string")
    r = two.select(fingerprint.combine("c", "d").alias("put"), fingerprint.combine("a", "d", -1).alias("out"), fingerprint.combine(fingerprint.combine("a", "e", -1), F.col("e")).alias("same"), fingerprint.combine("a", "e", -1).alias("rest")).first()
    assert (r["put"], r["out"], r["same"], r["rest"]) == (f[1], f[3], f[1], f[4])


def test_fingerprints_estimate_likeness_within_the_error_of_128_lanes(spark):
    rows = []
    for i in range(400):  # 120 of 200 word pairs are in both texts
        common = [f"c{i}x{j}" for j in range(120)]
        rows += [(2 * i, " ".join(common + [f"a{i}x{j}" for j in range(40)])), (2 * i + 1, " ".join(common + [f"b{i}x{j}" for j in range(40)]))]
    out = fingerprint.edited_fingerprints(spark.createDataFrame(rows, "doc_id bigint, text string"))
    near = np.array([r["near_next"] for r in out.where("doc_id % 2 = 0").select("near_next").collect()])
    assert len(near) == 400 and abs(near.mean() - 0.6) < 0.02 and np.sqrt(np.mean((near - 0.6) ** 2)) < 0.058


def test_bpe_equals_tiktoken(odd, none, docs):
    import tiktoken

    path, pattern = bpe.public_ranks()
    own = bpe.BytePairEncoder.from_tiktoken(open(path, "rb").read(), pattern)
    right = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=own.ranks, special_tokens={})
    odd_texts = ["a" * 5000, "=" * 777, "ab" * 900, "中文 字符 <|endoftext|> \x1c\x85　x", "it's  'll \n\n x", "", "ŉǅЖ½²"]
    for t in odd_texts + [r["text"] for r in docs.limit(40).collect()]:
        assert own.encode(t) == right.encode_ordinary(t) and own.decode(own.encode(t)) == t.encode()
    for r, row in zip(bpe.encode(odd, path, pattern).collect(), ROWS, strict=True):
        ids = right.encode_ordinary(row[1] or "")
        assert (r["n_tokens"], r["ids"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), ids, hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((row[1] or "").encode()).hexdigest())
    assert bpe.encode(none, path, pattern).count() == 0


def test_workers_keep_no_pieces_between_tasks(spark):
    docs = spark.createDataFrame([(i, f"piece{i} of text{i}") for i in range(200)], "doc_id bigint, text string").coalesce(1)
    assert bpe.encode(docs, *bpe.public_ranks()).count() == 200

    def held(batches):
        for batch in batches:
            n = [sum(len(e.known) + len(e.decoded) for e in bpe._ENCODERS.values())]
            yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64()), pa.array([len(bpe._ENCODERS)], pa.int64())], names=["n", "encoders"])

    found = spark.range(64, numPartitions=16).mapInArrow(held, "n long, encoders long").collect()
    assert any(r["encoders"] for r in found) and not any(r["n"] for r in found)


def test_workers_release_memory_when_a_task_ends_or_is_cut_short(monkeypatch):
    calls = []
    monkeypatch.setattr(common, "release", lambda: calls.append(1))
    assert list(common.frees(lambda batches: iter(batches))([1, 2])) == [1, 2] and len(calls) == 1
    cut = common.frees(lambda batches: iter(batches))([1, 2])
    assert next(cut) == 1 and len(calls) == 1
    cut.close()
    assert len(calls) == 2


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(150)
    kept = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "tokens":
            assert out.columns == docs.columns
        docs = corpus_pipeline.saved(out, "t")
        kept.append(docs.count())
    assert all(a >= b for a, b in zip(kept, kept[1:4], strict=False))
    assert kept[1] <= kept[0] and kept[3] <= kept[2] <= kept[1] and docs.where("n_tokens is null").count() == 0


def test_pipeline_stages_on_odd_and_empty_tables(spark, odd, none):
    import corpus_pipeline

    clashes = odd.withColumns({c: F.lit(1) for c in ("row", "text_hash", "n", "position", "component", "lead")})
    for start in (clashes, none):
        docs = start
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            if name != "tokens":
                assert out.columns == docs.columns, name
            docs = corpus_pipeline.saved(out, "t")
        assert docs.count() > 0 if start is clashes else docs.count() == 0


def test_pipeline_stages_by_brute_force(spark):
    import corpus_pipeline

    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 120")
    model = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    want = {r["doc_id"] for r in docs.collect() if model.score(np.frombuffer((r["text"] or "").encode(), np.uint8), np.array([0, len((r["text"] or "").encode())]))[0] >= 0.3}
    assert {r["doc_id"] for r in stages["quality"](spark, docs, SF).collect()} == want
    found = brute_components([(r["doc_id"], r["text"]) for r in docs.collect()], 5, 80)
    assert {r["doc_id"] for r in stages["near_duplicates"](spark, docs, SF).collect()} == {i for i, (_, c) in found.items() if i == c}
    plan = {r["doc_id"]: len(r["positions"]) for r in mixing.plan_mix(docs).collect()}
    assert Counter(r["doc_id"] for r in stages["mix"](spark, docs, SF).collect()) == Counter({i: n for i, n in plan.items() if n})
    gone = {(r["doc_id"], r["pos"]) for r in line_dedup.duplicate_lines(docs, min_chars=1).collect()}
    text = {r["doc_id"]: "\n".join(x for i, x in enumerate((r["text"] or "").split("\n")) if (r["doc_id"], i) not in gone) for r in docs.collect()}
    left = {i: t for i, t in text.items() if t.strip(" \n") or not any(d == i for d, _ in gone)}
    assert {r["doc_id"]: r["text"] or "" for r in stages["line_dedup"](spark, docs, SF).collect()} == left
