"""The corpus queries on the generated tables: DuckDB where SQL can express them, brute force elsewhere."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import oracle
import pyarrow.parquet as pq
import pytest
from spriteloom.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs():
    return pq.read_table(f"{DATA}/documents.parquet").to_pylist()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_duckdb(spark, name):
    assert oracle.differences(queries.queries()[name](spark, DATA), oracle.duck(DATA), queries.oracle_sql()[name]) == []


def test_frequent_lines_against_duckdb(spark):
    data = "/root/testdata/sf0.01"  # here lines do exceed the production limits
    got = queries.queries()["op5_quality_rules"](spark, data)
    assert got.where("lost_lines > 0").count() > 0
    assert oracle.differences(got, oracle.duck(data), queries.oracle_sql()["op5_quality_rules"]) == []


def luhn(digits):
    return sum(int(c) if k % 2 == 0 else (2 * int(c) - 9 * (int(c) > 4)) for k, c in enumerate(reversed(digits))) % 10 == 0


PRIVATE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
SECRET = {"assign": r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "access": "AKIA[A-Z0-9]+", "hex": "[0-9a-f]+"}


def is_private(kind, found):
    digits = re.sub("[^0-9]", "", found)
    if kind == "ip":
        return all(int(p) <= 255 for p in found.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 10 <= len(digits) <= 15


def is_secret(kind, m):
    return len(m[2]) >= 6 if kind == "assign" else len(m[0]) >= (20 if kind == "access" else 24)


def base(text, patterns, good):
    found = sorted((m.start(), i, m.end(), k) for i, (k, p) in enumerate(patterns.items()) for m in re.finditer(p, text or "", re.A) if good(k, m))
    return [f"{k}:{a}:{b}" for a, _, b, k in found]


@pytest.mark.parametrize(("name", "patterns", "good"), [("op4_private_data", PRIVATE, lambda k, m: is_private(k, m[0])), ("op9_secret_scan", SECRET, is_secret)])
def test_base_spans(spark, docs, name, patterns, good):
    got = {r["doc_id"]: r for r in queries.queries()[name](spark, DATA).collect()}
    assert len(got) == len(docs)
    for d in docs:
        want, r = base(d["text"], patterns, good), got[d["doc_id"]]
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in patterns] == [sum(w.startswith(k + ":") for w in want) for k in patterns]
        spans = r["spans"].split(",") if r["spans"] else []
        assert set(want) <= set(spans) and len(spans) == len(want) + r["n_found"]


def test_simhash(spark, docs):
    import xxhash

    got = {r["doc_id"]: r for r in queries.queries()["op8_simhash_dedup"](spark, DATA).collect()}
    prints = {}
    for d in docs:
        words = d["text"].encode().lower().split()
        grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        ones = [0] * 64
        for g in grams:
            h = xxhash.xxh64_intdigest(g, 42)
            for b in range(64):
                ones[b] += h >> b & 1
        prints[d["doc_id"]] = sum(1 << b for b in range(64) if 2 * ones[b] > len(grams))
    root = {i: i for i in prints}
    changed = True
    while changed:
        changed = False
        for i in prints:
            for j in prints:
                if (prints[i] ^ prints[j]).bit_count() <= 3 and root[i] < root[j]:
                    root[j], changed = root[i], True
    assert {i: (r["fingerprint"], r["component_id"]) for i, r in got.items()} == {i: (f"{p:016x}", root[i]) for i, p in prints.items()}


def test_lines(spark, docs):
    lines = [(d["doc_id"], n, re.sub(r"[\x09-\x0d ]+", " ", x).strip(" ")) for d in docs for n, x in enumerate(d["text"].split("\n"))]
    first = {}
    for i, n, x in sorted(lines):
        if x:
            first.setdefault(x, (i, n))
    grams = {x: {m[1] for m in re.finditer(r"(?s)(?=(.{1,12}))[^ ]{1,8}+ *+", x)} for x in first}
    owners = defaultdict(list)
    root = {x: x for x in first}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, mine in grams.items():
        shared = Counter(o for g in mine for o in owners[g])
        for o, n in shared.items():
            if n >= 0.8 * (len(mine) + len(grams[o]) - n) and find(o) != find(x):
                root[find(x)] = find(o)
        for g in mine:
            owners[g].append(x)
    best = {}
    for x in first:
        best[find(x)] = min(best.get(find(x), first[x]), first[x])
    got = {(r["doc_id"], r["line_no"]): (r["class_doc_id"], r["class_line_no"]) for r in queries.queries()["op3_line_dedup"](spark, DATA).collect()}
    want = {(i, n): best[find(x)] for i, n, x in lines if x}
    assert set(got) == set(want)
    assert sum(got[k] != want[k] for k in want) <= 0.02 * len(want)  # banding finds nearly all pairs, not all


def test_leaks(spark, docs):
    items = pq.read_table(f"{DATA}/benchmark.parquet").to_pylist()
    flat = lambda text: " " + " ".join(re.findall(r"\w+", text.lower())) + " "
    whole = {(d["doc_id"], b["item_id"]) for d in docs for b in items if flat(b["text"]) in flat(d["text"])}
    got = {(r["doc_id"], r["item_id"]): r for r in queries.queries()["op1_decontamination"](spark, DATA).collect()}
    assert whole and whole <= set(got) and all(got[k]["coverage"] == 1 for k in whole)
    assert {i for i, _ in got} == {i for i, _ in whole}


def test_token_counts(spark, docs):
    from spriteloom.llm.token_trie import load_pieces

    pieces = load_pieces()
    longest, other = max(map(len, pieces)), min(pieces.values()) - 10
    memo = {}

    def tokens(word):
        text = "▁" + word
        if text not in memo:
            best = [(0.0, 0)]
            for at in range(1, len(text) + 1):
                options = [(best[at - n][0] + pieces[text[at - n : at]], best[at - n][1] + 1) for n in range(min(at, longest), 0, -1) if text[at - n : at] in pieces]
                if text[at - 1] not in pieces:
                    n = len(text[at - 1].encode())
                    options.append((best[at - 1][0] + other * n, best[at - 1][1] + n))
                best.append(max(options, key=lambda o: o[0]))
            memo[text] = best[-1][1]
        return memo[text]

    got = {r["doc_id"]: (r["n_words"], r["n_tokens"]) for r in queries.queries()["op2_token_counts"](spark, DATA).collect()}
    for d in docs:
        words = [w.decode() for w in d["text"].encode().split()]
        assert got[d["doc_id"]] == (len(words), sum(map(tokens, words)))


def test_toxicity_on_held_out_rows(spark):
    data = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["toxic"] for r in pq.read_table(f"{data}/labels.parquet").to_pylist()}
    got = queries.queries()["op10_toxicity"](spark, data).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)
    held = [(labels[r["doc_id"]], r["predicted"]) for r in got if r["held_out"] and r["doc_id"] in labels]
    n = Counter(held)
    assert n[1, 1] / (n[1, 1] + n[1, 0]) > 0.8 and n[1, 1] / (n[1, 1] + n[0, 1]) > 0.9
