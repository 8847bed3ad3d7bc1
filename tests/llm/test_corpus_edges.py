"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from spriteloom.llm import common, decontaminate, line_frequency, minhash_lines, mixture, private_data, secret_scan, simhash_dedup, token_trie, toxicity, warc_zstd

PROSE = "the quick brown fox jumps over the lazy dog while seven wizards brew strong potions beneath a pale crescent moon and nobody notices them at all tonight"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, None), (2, ""), (3, " \t\n\n"), (4, PROSE), (4, PROSE), (5, PROSE), (None, PROSE + " once more"), (6, "x" * 200_000), (7, "ab " * 40_000), (8, "1" * 30_000), (9, "é\x00\x0b" + PROSE.upper()), (10, "\n".join([PROSE, PROSE, "short", ""])), (10, "another text under the same id")]
    return spark.createDataFrame([(i, t, None, ["a", None][(i or 0) % 2], len(t or "")) for i, t in rows], SCHEMA).cache()


@pytest.fixture(scope="module")
def clash(odd):
    """With extra columns under names that operators use inside."""
    extra = ["id", "key", "band", "low", "fp", "size", "taken", "kept", "host", "u", "v", "node", "root", "label", "quota", "pos", "line", "place", "__key_doc_id", "__gone", "n", "block"]
    return odd.withColumns({c: F.lit("?") for c in extra})


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, PROSE[:120]), (2, None), (3, ""), (4, "too few words"), (5, "nothing of this kind is ever said in any of the documents here")], "item_id long, text string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(4, 1, 0), (4, 1, 1), (5, 0, None), (None, 1, 1), (9, 1, 0)], "doc_id long, quality int, toxic int")


def operators(bench, labels):
    return {
        "op1": lambda d: decontaminate.find_leaks(d, bench),
        "op2": token_trie.token_counts,
        "op3": minhash_lines.line_classes,
        "op4": private_data.find_private_data,
        "op5": line_frequency.quality_verdicts,
        "op6": mixture.mix,
        "op8": simhash_dedup.simhash_components,
        "op9": secret_scan.find_secrets,
        "op10": lambda d: toxicity.score_toxicity(d, labels),
        "quality stage": line_frequency.keep_good,
        "line stage": minhash_lines.drop_repeated_lines,
        "near stage": simhash_dedup.drop_near_copies,
        "leak stage": lambda d: decontaminate.drop_leaking(d, bench),
    }


NAMES = ["op1", "op2", "op3", "op4", "op5", "op6", "op8", "op9", "op10", "quality stage", "line stage", "near stage", "leak stage"]


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows_and_clashing_columns(odd, clash, bench, labels, name):
    run = operators(bench, labels)[name]
    got = run(odd)
    rows = sorted(map(str, got.collect()))
    if name in ("op2", "op4", "op5", "op6", "op8", "op9", "op10"):
        assert len(rows) == odd.count()  # a row for every row
    again = run(clash)
    if "stage" in name:
        assert again.columns == clash.columns and again.dtypes[:5] == odd.dtypes
    assert sorted(map(str, again.select(got.columns).collect())) == rows


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(spark, odd, bench, labels, name):
    none = spark.createDataFrame([], SCHEMA)
    got = operators(bench, labels)[name](none)
    assert got.count() == 0 and got.columns == operators(bench, labels)[name](odd).columns


def test_leaks(spark, odd, bench):
    got = {(r["doc_id"], r["item_id"]): r["coverage"] for r in decontaminate.find_leaks(odd, bench).collect()}
    assert set(got) == {(i, 1) for i in (None, 4, 5, 9, 10)} and min(got.values()) > 0.9
    words = PROSE[:120].split()
    mixed = " ".join(["unrelated opening"] + words[12:] + ["filler words here"] + words[:12])
    rows = spark.createDataFrame([(1, mixed), (2, " ".join(words[:9]) + " and then it turns to other things")], "doc_id long, text string")
    found = decontaminate.find_leaks(rows, bench).collect()
    assert [r["doc_id"] for r in found] == [1] and found[0]["n_tiles"] == 2
    assert decontaminate.find_leaks(rows, bench, slice_tokens=1).count() == 1  # an item at a time
    assert [r["doc_id"] for r in decontaminate.drop_leaking(rows, bench).collect()] == [2]


def test_tiles_do_not_overlap_and_longest_come_first():
    r = np.random.default_rng(0)
    for _ in range(60):
        doc, item = r.integers(0, 4, 60), r.integers(0, 4, 25)
        tiles = decontaminate.tile(doc, item, 3)
        for i, j, n in tiles:
            assert n >= 3 and (doc[i : i + n] == item[j : j + n]).all()
        for side, length in ((0, 60), (1, 25)):
            used = np.zeros(length, int)
            for t in tiles:
                used[t[side] : t[side] + t[2]] += 1
            assert used.max(initial=0) <= 1
        free_doc, free_item = np.ones(60, bool), np.ones(25, bool)
        for i, j, n in tiles:
            free_doc[i : i + n] = free_item[j : j + n] = False
        left = [(i, j) for i in range(58) for j in range(23) if free_doc[i : i + 3].all() and free_item[j : j + 3].all() and (doc[i : i + 3] == item[j : j + 3]).all()]
        assert not left  # nothing that could still be a tile


def test_lines(spark):
    near = PROSE.replace("pale", "dim")
    rows = [(2, f"{PROSE}\nkeep me here", "x", "s", 0), (1, f"first line\n\n{near}\nfirst line", "x", "s", 0), (3, "first line", "x", "s", 0), (4, "", "x", "s", 0), (5, None, "x", "s", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    long = PROSE + " " + PROSE.upper()
    docs = docs.union(spark.createDataFrame([(6, long, "x", "s", 0), (7, long.replace("PALE", "DIM"), "x", "s", 0)], SCHEMA))
    got = {(r["doc_id"], r["line_no"]): (r["class_doc_id"], r["class_line_no"], r["kept"]) for r in minhash_lines.line_classes(docs).collect()}
    assert got[1, 0] == (1, 0, True) and got[1, 3] == (1, 0, False) and got[3, 0] == (1, 0, False)
    assert got[7, 0] == (6, 0, False) and got[1, 2] == (1, 2, True) and got[2, 0] == (1, 2, False)
    out = {r["doc_id"]: (r["text"], r["n_chars"]) for r in minhash_lines.drop_repeated_lines(docs).collect()}
    assert set(out) == {1, 2, 4, 5, 6} and out[2][0] == "keep me here" and out[1][0] == f"first line\n\n{near}" and out[1][1] == len(out[1][0]) and out[5] == (None, 0)


def test_near_lines_by_all_character_shingles(spark):
    r = np.random.default_rng(3)
    lines = []
    for at in (5, 100, 200):  # one character put into a text without spaces
        line = "".join(map(chr, r.integers(0x4E00, 0x9000, 400)))
        lines += [line, line[:at] + "中" + line[at:]]
    for n in range(30):  # words replaced in a text with spaces
        words = ["".join(r.choice(list("etaoinshrdlu"), r.integers(2, 10))) for _ in range(40)]
        lines += [" ".join(words), " ".join(w if k not in (7, 30)[: n % 3] else "other" for k, w in enumerate(words))]
    lines += ["abcdefgh", "abcdefgh ijklmnop qrstuvwx"]
    sets = [{x[i : i + 12] for i in range(max(1, len(x) - 11))} for x in lines]
    alike = lambda a, b: len(a & b) / len(a | b)
    pairs = [(i, i + 1) for i in range(0, len(lines) - 2, 2)]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    got = {x["doc_id"]: x["class_doc_id"] for x in minhash_lines.line_classes(docs).collect()}
    assert all(alike(sets[i], sets[j]) > 0.9 for i, j in pairs[:3]) and all(got[j] == i for i, j in pairs[:3])
    sure = [(i, j) for i, j in pairs if alike(sets[i], sets[j]) >= 0.85]
    assert len(sure) > 20 and sum(got[j] != i for i, j in sure) <= 1  # bands may miss one
    assert all(got[j] == j for i, j in pairs if alike(sets[i], sets[j]) < 0.8)
    assert got[len(lines) - 1] == len(lines) - 1


def jaccard(x, y, size=12):
    x, y = ({t[i : i + size] for i in range(max(1, len(t) - size + 1))} for t in (x, y))
    return len(x & y) / len(x | y)


@pytest.mark.parametrize("crowd", [0, 1_000_000])
def test_open_bands_lose_no_link(spark, crowd):
    """Lines that share a long passage: components by prefix filtering (crowd 0) and pair by pair against all pairs."""
    import random

    r = random.Random(5)
    words = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(3, 9))) for _ in range(400)]
    passage = [r.choice(words) for _ in range(40)]
    texts = []
    for family in range(12):
        tail = [r.choice(words) for _ in range(6 + family)]
        for _ in range(12):
            line = passage + tail
            for _ in range(r.randint(0, 4)):
                line[r.randrange(len(line))] = r.choice(words)
            texts.append(" ".join(line))
    texts = sorted(set(texts))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    lines, roots = minhash_lines.line_components(docs, crowd=crowd)
    found = lines.join(roots, "id", "left").select("doc_id", "id", "root").collect()
    root = {x["doc_id"]: x["id"] if x["root"] is None else x["root"] for x in found}
    top = list(range(len(texts)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    links = [(i, k) for i in range(len(texts)) for k in range(i) if jaccard(texts[i], texts[k]) >= 0.8]
    for i, k in links:
        top[find(i)] = find(k)
    assert len(links) > 50
    assert {(i, k) for i in root for k in root if root[i] == root[k]} == {(i, k) for i in root for k in root if find(i) == find(k)}


def test_bands_of_some_lines_need_no_prefixes(spark, monkeypatch):
    """150 lines with one passage in families of three: compared in the band itself, also across bands of one head, and no link is lost."""
    monkeypatch.setattr(minhash_lines, "_prefixes", lambda *_: pytest.fail("prefixes for a band of some lines"))
    passage = " ".join(f"mp{k}cd" for k in range(30))
    texts = [f"{passage} " + " ".join(f"tail{family}x{k}" for k in range(25)) + f" end{copy}" for family in range(50) for copy in range(3)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["class_doc_id"] for r in minhash_lines.line_classes(docs).collect()}
    assert jaccard(texts[0], texts[1]) >= 0.8 > jaccard(texts[0], texts[3])
    assert got == {k: k - k % 3 for k in range(150)}


def test_lines_of_all_white_space(spark):
    """Lines are cut at line feeds alone, all other white space is one space, and blank lines keep their numbers."""
    texts = ["a  b\n\t \r\n \n\x0b\x0c\nc\td\r\n e ", " \t", "", None, "x\ny  \n\n  z", "\u00a0\n\x0bq\x0c\x0cr"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r["doc_id"], r["pos"]): r["line"] for r in minhash_lines._lines(docs).collect()}
    want = {(i, n): re.sub(r"[\t\r\x0b\x0c ]+", " ", x).strip(" ") for i, t in enumerate(texts) for n, x in enumerate((t or "").split("\n"))}
    assert got == {k: x for k, x in want.items() if x}


def test_prefixes_put_out_a_pair_once(spark):
    """Lines of one family share most of their rarest shingles; a pair still leaves the join once, and no similar pair is lost."""
    words = [f"word{i}" for i in range(60)]
    texts = [" ".join([*words[: k % 50], f"odd{k % 7}", *words[k % 50 + 1 :], f"end{k % 5}"]) for k in range(60)]
    table = spark.createDataFrame(list(enumerate(texts)), "id long, line string")
    marks = common.materialize(minhash_lines._parities(table, 12), "test-marks")
    crowd, roots = table.select("id", F.col("id").alias("root")), spark.createDataFrame([], "node long, root long")
    prefixes = minhash_lines._prefixes(crowd, table, marks, 12, 0.8)
    pairs = minhash_lines._prefix_pairs(prefixes, roots, marks, 0.8, None)
    got = [(r["a"], r["b"]) for r in pairs.collect()]
    assert "Aggregate" not in pairs._jdf.queryExecution().optimizedPlan().toString() and len(got) == len(set(got))
    assert {(i, k) for k in range(60) for i in range(k) if jaccard(texts[i], texts[k]) >= 0.8} <= set(got)


def test_prefixes_hold_only_lines_that_may_meet(spark):
    """Lines that share a passage, but whose lengths do not fit, leave no rows; those whose lengths just fit lose no pair."""
    words = [f"word{i:03}" for i in range(900)]

    def found(texts):
        table = common.materialize(spark.createDataFrame(list(enumerate(texts)), "id long, line string"), "test-texts")
        marks = common.materialize(minhash_lines._parities(table, 12), "test-marks")
        prefixes = minhash_lines._prefixes(table.select("id", F.col("id").alias("root")), table, marks, 12, 0.8)
        pairs = minhash_lines._prefix_pairs(prefixes, spark.createDataFrame([], "node long, root long"), marks, 0.8, None)
        return prefixes.count(), {(r["a"], r["b"]) for r in minhash_lines._verified(pairs, table, marks, 12, 0.8).collect()}

    assert found([" ".join(words[: int(40 * 1.6**k)]) for k in range(6)]) == (0, set())
    texts = [" ".join([*words[k % 3 : 30 + k % 3 + k // 2], *[f"odd{k}"] * (k % 4 == 0)]) for k in range(50)]
    links = {(i, k) for k in range(50) for i in range(k) if jaccard(texts[i], texts[k]) >= 0.8}
    assert 100 < len(links) < 1000 and found(texts)[1] == links


@pytest.mark.parametrize("far", [[], [1 << 31], [-(1 << 31)], [(1 << 63) - 1, -(1 << 63)]])
def test_places_of_all_ids(spark, far):
    """Null, negative and the largest ids, whose places do not fit into a long."""
    ids = [5, None, 0, -3, (1 << 31) - 1, 1 - (1 << 31), *far]
    docs = spark.createDataFrame([(i, f"{hashlib.sha256(str(i).encode()).hexdigest()}\nthe same line in all of them") for i in ids], "doc_id long, text string")
    got = {(r["doc_id"], r["line_no"]): (r["class_doc_id"], r["class_line_no"], r["kept"]) for r in minhash_lines.line_classes(docs).collect()}
    assert got == {(i, 0): (i, 0, True) for i in ids} | {(i, 1): (None, 1, i is None) for i in ids}
    docs = docs.where("doc_id is not null")
    got = {r["doc_id"]: r["class_doc_id"] for r in minhash_lines.line_classes(docs).where("line_no = 1").collect()}
    assert got == dict.fromkeys((i for i in ids if i is not None), min(i for i in ids if i is not None))


def test_a_large_group_of_near_lines_is_one_class(spark):
    words = [f"word{i}" for i in range(60)]
    rows = [(k, " ".join([*words[:30], f"odd{k}", *words[31:]])) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert minhash_lines.line_classes(docs).where("kept").count() == 1


def test_quality(spark):
    name = lambda n: "".join(chr(97 + int(d)) for d in str(n))  # noqa: E731  digits are all alike to a line
    body = [f"document {name(k)} says " + " ".join(f"w{name(k)}x{name(i)}" for i in range(40)) for k in range(30)]
    noise = "this boilerplate line is on every page of the site and carries no information at all for anyone who came here to read something else"
    rows = [(k, f"{b}\n{noise}", "a") for k, b in enumerate(body)] + [(100 + k, f"{noise}\n{'tail ' + str(k)}", "a") for k in range(5)] + [(200, noise + "\nand its own words", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in line_frequency.quality_verdicts(docs, least_docs=10, share=0.05).collect()}
    assert got[0]["lost_lines"] == 0 and got[5]["lost_lines"] == 1 and got[5]["kept"]  # the first document keeps the line
    assert all(not got[100 + k]["base_failed"] and not got[100 + k]["kept"] for k in range(5))
    assert got[200]["lost_words"] == 0  # another host
    kept = {r["doc_id"] for r in line_frequency.keep_good(docs, least_docs=10, share=0.05).collect()}
    assert kept == {*range(30), 200}
    copies = spark.createDataFrame([(k, body[0], "a") for k in range(40)], "doc_id long, text string, source string")
    assert line_frequency.keep_good(copies, least_docs=10, share=0.05).count() == 40  # exact copies are one document


def test_frequent_lines_of_small_hosts_by_production_limits(spark):
    name = lambda n: "".join(chr(97 + int(d)) for d in str(n))
    line = "subscribe to our letter today and never miss any offer of this site again"
    text = lambda h, k, every: f"{h} page {name(k)} " + " ".join(f"w{name(k)}x{name(i)}" for i in range(30)) + (f"\n{line}" if k % every == 0 else "")
    rows = [(100 * h + k, text(f"host{name(h)}", k, every), f"host{h}") for h, (n, every) in enumerate([(50, 7), (50, 1), (10, 2), (10, 3)]) for k in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    lost = {r["doc_id"] for r in line_frequency.quality_verdicts(docs).where("lost_lines = 1").collect()}
    # 8 of 50, 50 of 50 and 5 of 10 texts are more than the floor, 4 of 10 are not; the first of a host keeps the line
    assert lost == {*range(7, 50, 7), *range(101, 150), *range(202, 210, 2)}


def test_frequent_lines_leave_the_texts(spark):
    name = lambda n: "".join(chr(97 + int(d)) for d in str(n))
    own = [f"page {name(k)} has {k} " + " ".join(f"w{name(k)}x{name(i)}" for i in range(30)) for k in range(8)]
    rows = [(k, f"PAGE {k}  of  90\n{t}\n\nall rights reserved by us\nend {name(k)}\nall rights reserved by us", "x", "a", 0) for k, t in enumerate(own)]
    rows += [rows[7], (50, "x " * 3, "x", "a", 7), (51, own[0] + " elsewhere", "x", "b", 7)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r["doc_id"], r["text"], r["n_chars"]) for r in line_frequency.keep_good(docs).collect())
    cut = [f"{t}\n\nend {name(k)}" for k, t in enumerate(own)]
    want = [(0, rows[0][1], 0)] + [(k, cut[k], len(cut[k])) for k in (*range(1, 8), 7)] + [(51, rows[-1][1], 7)]
    assert got == want and line_frequency.keep_good(docs).dtypes == docs.dtypes


def test_repeated_windows():
    def slow(words, size=8):
        at = [tuple(words[i : i + size]) for i in range(len(words) - size + 1)]
        return len({i + k for i, w in enumerate(at) if at.count(w) > 1 for k in range(size)})

    r = np.random.default_rng(1)
    for n in (0, 5, 8, 9, 40, 200):
        words = [bytes([97 + v]) for v in r.integers(0, 2, n)]
        assert line_frequency.repeated_window_words(words) == slow(words)


def test_mixture_is_near_its_targets_and_repeats(spark):
    r = np.random.default_rng(2)
    rows = [(i, "w " * int(n), s) for i, (n, s) in enumerate(zip(r.integers(0, 400, 600), r.choice(["a", "b", "c", None], 600, p=[0.7, 0.2, 0.05, 0.05]), strict=True))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    run = lambda: sorted(map(tuple, mixture.mix(docs, shard_tokens=5000).collect()), key=str)
    one = run()
    assert one == run()
    total, targets, sizes, taken = 0, {}, {}, {}
    for _, s, n, source_size, target, t in one:
        assert 0 <= t <= 3 * n
        total += n
        targets[s], sizes[s] = target, source_size
        taken[s] = taken.get(s, 0) + t
    assert abs(sum(targets.values()) - total) < 1e-3
    for s, target in targets.items():
        assert target <= 3 * sizes[s] + 1e-6 and abs(taken[s] - target) <= 0.03 * target + 50


def test_targets_by_slow_filling(spark):
    sizes = {"a": 10, "b": 1000, "c": 0, "d": 50, "e": 5}
    weights = dict(zip(sizes, (5, 2, 1, 5, 2), strict=True))
    left, fixed, pool = dict(weights), {}, sum(sizes.values())
    while True:
        level = (pool - sum(fixed.values())) / sum(left.values())
        over = [s for s in left if left[s] * level > 3 * sizes[s]]
        if not over:
            break
        for s in over:
            fixed[s] = 3 * sizes[s]
            del left[s]
    want = fixed | {s: w * level for s, w in left.items()}
    got = {r["source"]: r["target"] for r in mixture.source_targets(spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()}
    assert got == pytest.approx(want)


def test_apportionment_by_highest_quotients(spark):
    r = np.random.default_rng(3)
    for total in (0, 1, 7, 100):
        want = r.integers(1, 50, 6).astype(float)
        room = r.integers(1, 60, 6)
        seats = [0] * 6
        for _ in range(min(total, int(room.sum()))):
            free = [i for i in range(6) if seats[i] < room[i]]
            seats[max(free, key=lambda i: (want[i] / (2 * seats[i] + 1), -i))] += 1
        rows = spark.createDataFrame([(1, i, float(want[i]), total, int(room[i])) for i in range(6)], "g int, k int, want double, total long, room long")
        got = {q["k"]: q["quota"] for q in mixture.apportion(rows, ["g"], ["k"], "want", "total", "room").collect()}
        assert [got[i] for i in range(6)] == seats


def test_archives(spark, tmp_path):
    big = "<p>" + "same " * 400
    rows = [(1, "http://a/1", big), (2, "http://a/2\r\nX: y", big), (3, None, big), (4, "u", "small"), (5, "u", "small"), (6, "u", None), (None, "u", big + "!"), (7, "ü", "é" * 2000 + "\r\n\r\n")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    made = warc_zstd.write_archives(pages, archive_bytes=3000, dictionary=b"")
    got = {r["page_id"]: r for r in warc_zstd.read_archives(made).collect()}
    for i, _, html in rows:
        payload = (html or "").encode()
        assert got[i]["payload_bytes"] == len(payload) and got[i]["payload_digest"] == hashlib.sha1(payload).hexdigest()
    assert {i: (r["record_type"], r["refers_to"]) for i, r in got.items() if r["record_type"] == "revisit"} == {1: ("revisit", 3), 2: ("revisit", 3)}
    assert bytes(got[7]["payload"]).decode() == rows[7][2]
    warc_zstd.save_archives(made, str(tmp_path))
    assert warc_zstd.read_archives(warc_zstd.load_archives(spark, f"file://{tmp_path}")).count() == len(rows)
    assert warc_zstd.archive_round_trip(pages.limit(0)).count() == 0


def test_archive_format():
    import zstandard

    samples = [f"<html><p>{'common markup ' * 20}{i}</p></html>".encode() * 5 for i in range(400)]
    words = zstandard.train_dictionary(4096, samples).as_bytes()
    encoder = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(words), write_checksum=True)
    records = [warc_zstd.record_bytes(i, "u", s, hashlib.sha1(s).hexdigest(), None, "2024-01-01T00:00:00Z") for i, s in enumerate(samples[:5])]
    data = warc_zstd.archive_head(words) + b"".join(map(encoder.compress, records))
    assert [r.payload for r in warc_zstd.read_archive(data)] == samples[:5]
    packed = zstandard.ZstdCompressor().compress(words)  # the dictionary may be compressed, and other skippable frames may follow
    data = warc_zstd.archive_head(packed) + b"\x50\x2a\x4d\x18\x02\x00\x00\x00zz" + encoder.compress(records[0])
    assert len(list(warc_zstd.read_archive(data))) == 1
    for broken in (data[:-3], data + b"rubbish", data[:-9] + b"123456789"):
        with pytest.raises(warc_zstd.ArchiveError):
            list(warc_zstd.read_archive(broken))
    for bad in (b"HTTP/1.1 200\r\n\r\n", records[0].replace(b"WARC-Date", b"WARC Date"), records[0] + b"x", records[0].replace(b"Content-Length: ", b"Content-Length: 9", 1)):
        with pytest.raises(warc_zstd.ArchiveError):
            warc_zstd.parse_record(bad)
    assert list(warc_zstd.read_archive(b"")) == []


@pytest.mark.parametrize("bucket", [256, 8192])
def test_links_stay_exact_when_buckets_split(spark, bucket):
    r = np.random.default_rng(4)
    centre = int(r.integers(0, 1 << 62))
    prints = {centre}
    for _ in range(400):
        p = centre
        for b in r.integers(0, 64, int(r.integers(0, 7))):
            p ^= 1 << int(b)
        prints.add(p)
    prints = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    links = simhash_dedup.close_links(spark.createDataFrame([(p,) for p in prints], "fp long"), 3, bucket)
    pairs = links.collect()
    far = lambda a, b: ((a ^ b) & ((1 << 64) - 1)).bit_count()
    assert all(far(x["a"], x["b"]) <= 3 for x in pairs)
    assert classes(prints, [(x["a"], x["b"]) for x in pairs]) == classes(prints, [(a, b) for a in prints for b in prints if a < b and far(a, b) <= 3])


def classes(nodes, pairs):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            root[n] = root[root[n]]
            n = root[n]
        return n

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_connected_components(spark):
    r = np.random.default_rng(5)
    for pairs in ([(i, i + 1) for i in range(60)], [(0, i) for i in range(50)], [(int(a), int(b)) for a, b in r.integers(0, 80, (60, 2))], [(5, 5)], []):
        frame = spark.createDataFrame(pairs, "a long, b long")
        nodes = {n for p in pairs for n in p}
        assert {x["node"]: x["root"] for x in common.connected_components(frame, "a", "b").collect()} == classes(nodes, pairs)


def test_copies(spark):
    rows = [(9, PROSE), (3, PROSE), (7, PROSE + " indeed"), (8, "quite another text about " + PROSE[::-1]), (1, ""), (2, None), (None, PROSE)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in simhash_dedup.simhash_components(docs).collect()}
    assert got[9]["component_id"] == got[3]["component_id"] == got[None]["component_id"] == 3
    assert got[1]["fingerprint"] == got[2]["fingerprint"] == "0" * 16 and got[2]["component_id"] == 1
    kept = [r["doc_id"] for r in simhash_dedup.drop_near_copies(docs).collect()]
    assert {1, 3, 8, None} <= set(kept) and 9 not in kept and 2 not in kept


def test_discovery_by_context(spark):
    rows = [(i, f"please write to mailbox user{i}@site{i}.example.com for details") for i in range(40)]
    rows += [(100 + i, f"please write to mailbox other{i}@intranet{i} for details") for i in range(3)]
    rows += [(200, "he said @ noon that a@b is not an address"), (201, "version 10.20.30.400 of it")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in private_data.find_private_data(docs).collect()}
    assert all(got[100 + i]["n_email"] == 0 and got[100 + i]["n_found"] == 1 for i in range(3))
    text = rows[40][1]
    a, b = map(int, got[100]["spans"].split(":")[1:])
    assert got[100]["spans"].startswith("email:") and text[a:b] == "other0@intranet0"
    assert got[200]["n_found"] == 0 and got[201]["spans"] == ""


def test_many_spans_in_one_text(spark):
    text = " ".join(f"1.2.3.{i % 300}" for i in range(5000))
    row = private_data.find_private_data(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()[0]
    assert row["n_ip"] == sum(i % 300 <= 255 for i in range(5000))
    last = [s for s in row["spans"].split(",") if s.startswith("ip")][-1]
    a, b = map(int, last.split(":")[1:])
    assert text[a:b] == "1.2.3.199"


def test_network_finds_other_secrets():
    r = np.random.default_rng(6)
    hexes = lambda n: "".join(r.choice(list("0123456789abcdef"), n))
    words = lambda n: " ".join("".join(r.choice(list("etaoinshr"), 6)) for _ in range(n))
    positive = [(words(3)[-16:] + " token = ", hexes(32), " " + words(1)) for _ in range(150)]
    negative = [(words(4)[-24:], "".join(r.choice(list("etaoinshr"), 18)) + str(i), " " + words(1)) for i in range(300)]
    net = secret_scan.fit(positive, negative)
    score = lambda rows: net.score(np.array([secret_scan.encode(*w) for w in rows]))
    fresh = [(words(3)[-16:] + " value is ", hexes(20), " x") for _ in range(50)]
    plain = [(words(4)[-24:], "".join(r.choice(list("etaoinshr"), 18)) + "77", " x") for i in range(50)]
    assert (score(fresh) > 0.5).mean() > 0.9 and (score(plain) > 0.5).mean() < 0.05 and net.threshold >= secret_scan.LEAST_SCORE
    assert secret_scan.fit([], negative) is None


def test_long_runs_are_scored_whole(spark):
    key, path = "xK9mP2qL7vR4tZ8w", "/v2/organisations/settings/integrations/webhooks/deliveries/"
    for n in (1, 39, 40, 41, 60, 61, 200):
        text = "b" * 30 + "".join(map(chr, range(0x4E00, 0x4E00 + n))) + "a" * 30
        found = secret_scan.windows(text, 30, 30 + n)
        assert set("".join(w[1] for w in found)) == set(text[30 : 30 + n]) and all(len(w[1]) == min(n, 40) and text.find("".join(w)) >= 0 for w in found)

    rows = [(1, f"GET {path}{key} now"), (2, f"GET {path} now"), (3, f"see {path}{key}{path} now")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    table = secret_scan.span_table(docs).collect()
    assert {r["doc_id"]: any(key in w["body"] for f in r["found"] for w in f["windows"]) for r in table} == {1: True, 2: False, 3: True}
    mixed = secret_scan.span_table(spark.createDataFrame([(1, "run 0123456789-0123456789-abcdef-0123456789-abcdeZyxwvq end")], "doc_id long, text string")).collect()[0]["found"]
    assert [f["kind"] for f in mixed] == [0]


def test_threshold_keeps_the_recall():
    r = np.random.default_rng(8)
    body = lambda: "".join(r.choice(list("abcdefgh01"), 20))
    positive = [("key ", body(), " x") for _ in range(200)]
    negative = [("key ", body(), " x") for _ in range(400)]  # not to be told apart: the scores of true secrets are low
    net = secret_scan.fit(positive, negative)
    assert net.recall >= secret_scan.RECALL and net.threshold < 0.9
    x, y = np.array([secret_scan.encode(*w) for w in positive + negative]), np.repeat([1.0, 0.0], [200, 400])
    net.calibrate(x, y)
    assert (net.score(x[:200]) >= net.threshold).mean() >= secret_scan.RECALL


def test_training_takes_every_window(spark):
    """More than 3,000 windows of a label, in many shards: each is learned from or held out, and the sums over shards are those over all rows."""
    r = np.random.default_rng(7)
    word = lambda n: "".join(r.choice(list("etaoinshr"), n))
    texts = [f"{word(9)} {word(18)}{i} {word(5)}" for i in range(3300)] + [f'{word(9)} token = "{"".join(r.choice(list("0123456789abcdef"), 40))}" {word(5)}' for _ in range(40)]
    table = common.materialize(secret_scan.span_table(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")), "test-spans")
    windows = {(w["before"], w["body"], w["after"], f["label"]) for row in table.collect() for f in row["found"] for w in f["windows"]}
    assert sorted(sum(w[3] == label for w in windows) for label in (0, 1)) == [40, 3300]
    shards = secret_scan.dealt(table, shard=512).orderBy("shard").collect()
    rows = lambda x, y: [(bytes(x[72 * i : 72 * i + 72]), y[i]) for i in range(len(y))]
    learned, held = [[w for s in shards for w in rows(s[x], s[y])] for x, y in (("x", "y"), ("hx", "hy"))]
    assert len(shards) == 7 and len(held) == len(set(held)) and not set(held) & set(learned)
    assert set(held) | set(learned) == {(secret_scan.encode(*w[:3]).astype(np.uint8).tobytes(), w[3]) for w in windows}
    assert all(len(set(s["y"])) == 2 for s in shards)

    net, again = (secret_scan.train_on(table, shard=512) for _ in range(2))
    assert (net.pack() == again.pack()).all() and (net.a, net.b, net.threshold) == (again.a, again.b, again.threshold)
    parts = [secret_scan._arrays(s["hx"], s["hy"], secret_scan.SEED + s["shard"]) for s in shards]
    x, y = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    found = net.a, net.b, net.threshold, net.recall
    net.calibrate(x, y)
    assert np.allclose(found, (net.a, net.b, net.threshold, net.recall), atol=1e-6) and net.recall >= secret_scan.RECALL
    score = lambda rows: net.score(np.array([secret_scan.encode(*w) for w in rows]))
    assert (score([(f'{word(9)} token = "', "".join(r.choice(list("0123456789abcdef"), 40)), f'" {word(5)}') for _ in range(50)]) >= net.threshold).mean() > 0.9
    assert (score([(f"{word(9)} ", word(18) + "7", f" {word(5)}") for _ in range(50)]) >= net.threshold).mean() < 0.1


@pytest.mark.parametrize("size", [1, 7, 3000])
def test_ranked_logit(spark, size):
    z = np.round(np.random.default_rng(size).normal(size=size), 2)
    parts = [(k, bytearray(part.tobytes()), bytearray(np.ones(len(part)).tobytes())) for k, part in enumerate(np.array_split(z, 3))]
    logits = spark.createDataFrame(parts, "shard int, z binary, y binary")
    for k in {0, size // 50, size // 2, size - 1}:
        assert secret_scan._ranked(logits, k) == np.sort(z)[k]


def test_candidates_of_all_kinds():
    def found(text):
        return [text[a:b] for a, b in secret_scan.candidates(text, secret_scan.base_spans(text))]

    assert found("auth: q7Xv9LmT2") == ["q7Xv9LmT2"] and found("credential = hunter2Pa55word") == ["hunter2Pa55word"]
    assert found("pin 48213377") == ["48213377"] and found("the key is 'qzxvwkjh' today") == ["qzxvwkjh"]
    assert found("x QZXVWKJHGFDSAPOI y") == ["QZXVWKJHGFDSAPOI"] and found("x 4821337748213377 y") == ["4821337748213377"]
    assert found("name=QZXVWKJHGFDSAPOI") == ["QZXVWKJHGFDSAPOI"] and found("password = hunter2pass") == []
    assert found("some plain words, nothing more") == []
    run = "/some/long/path/to/" + "0123456789abcdef" * 2 + "/another/long/path/Z"
    assert found(run) == [run[:19], run[51:]]  # a base span takes its own part of a run only


def test_stages_judge_rows_not_ids(spark, bench):
    text = lambda k: " ".join(f"w{'abcdefghij'[k]}{x}" for x in PROSE.split())
    # rows without ids: only the first repeats a line at line 2; an id with two texts
    docs = spark.createDataFrame([(None, f"{text(0)}\nmid\n{text(0)}"), (None, f"{text(1)}\nother\n{text(2)}"), (5, text(3)), (5, f"{text(4)}"), (None, text(5)), (None, text(5))], "doc_id long, text string")
    got = sorted(r["text"] for r in minhash_lines.drop_repeated_lines(docs).collect())
    assert got == sorted([f"{text(0)}\nmid", f"{text(1)}\nother\n{text(2)}", text(3), text(4), text(5)])
    docs = spark.createDataFrame([(None, PROSE), (None, text(1)), (5, PROSE + " x"), (5, text(2)), (6, text(3))], "doc_id long, text string")
    assert sorted(r["text"] for r in decontaminate.drop_leaking(docs, bench).collect()) == [text(1), text(2), text(3)]
    docs = spark.createDataFrame([(None, text(1))] * 40 + [(7, text(2))] * 3 + [(7, text(3)), (8, text(3)), (9, text(2))], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["text"]) for r in simhash_dedup.drop_near_copies(docs).collect())
    assert got == [(0, text(1)), (7, text(2)), (7, text(3))]


def test_trie_is_bounded_and_long_words_agree():
    pieces = {"▁": -3.0, "▁ab": -1.0, "a": -2.0, "b": -2.5, "c": -2.0, "abc": -1.5}
    full, tiny = token_trie.TrieCounter(pieces), token_trie.TrieCounter(pieces, max_nodes=3)
    for word in (b"abab", b"abc", b"xyz", "é".encode(), b"abc" * 50, b"ab"):
        assert full[word] == tiny[word] == full.one_pass("▁" + word.decode())
    assert full["é".encode()] == 3  # the mark and two bytes
    assert len(tiny.best) <= 3 + 70


def test_label_model_trusts_votes_over_a_wrong_label():
    votes = np.zeros((200, 3))
    votes[:40] = 1
    labels = np.arange(200) < 40
    labels[3] = False
    q, hit, miss, share = toxicity.label_model(votes, labels)
    assert q[3] > 0.5 and (hit > 0.9).all() and (miss < 0.1).all() and (share < 1.01).all()


def test_row_numbers_of_files_and_of_other_tables(spark, tmp_path):
    """Rows are told apart, repeated ones too, and keep their numbers when they are read again."""
    rows = [(None, "same"), (1, "same"), (1, "same"), (2, None)] * 50
    path = str(tmp_path / "docs.parquet")
    spark.createDataFrame(rows, "doc_id long, `odd.name` string").repartition(5).write.parquet(path)
    docs = spark.read.parquet(path)
    for given in (docs, docs.where("doc_id is null or doc_id < 9"), docs.limit(0)):
        numbered = common.with_rows(given, "__row")
        assert numbered.columns == [*given.columns, "__row"]
        found, again = numbered.collect(), numbered.collect()
        assert len({r["__row"] for r in found}) == len(found) == given.count()
        assert sorted(r["__row"] for r in found) == sorted(r["__row"] for r in again)
        key = lambda r: (r["__row"], r["doc_id"], r["odd.name"])
        assert set(map(key, found)) == set(map(key, again))
