"""The whole pipeline against a slow version of all its stages, on the generated documents."""

import re
import shutil
from collections import Counter, defaultdict

import duckdb
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import xxhash

DATA = "/root/testdata/sf0.001"
SPACE = "\t\n\v\f\r "


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def cut(doc, gone):
    return doc | {"text": "\n".join(x for i, x in enumerate(doc["text"].split("\n")) if i not in gone)} if gone else doc


def quality(docs):
    def normal(line):
        return re.sub(r"[\x20\x09-\x0D]+", " ", re.sub("[0-9]+", "0", line.lower())).strip(" ")

    holders, hosts = defaultdict(dict), defaultdict(set)
    for d in docs:
        for x in (d["text"] or "").split("\n"):
            if words(x):
                holders[d["source"], normal(x)].setdefault(d["text"], []).append(d["doc_id"])
                hosts[d["source"]].add(d["text"])
    often = {k: min(min(v) for v in by.values()) for k, by in holders.items() if len(by) > max(4, 0.01 * len(hosts[k[0]]))}
    out = []
    for d in docs:
        w = words(d["text"])
        seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        repeated = {i + k for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for k in range(8)}
        lines = (d["text"] or "").split("\n")
        gone = {i for i, x in enumerate(lines) if words(x) and often.get((d["source"], normal(x)), d["doc_id"]) != d["doc_id"]}
        left = len(w) - sum(len(words(lines[i])) for i in gone)
        if len(w) >= 20 and 100 * len(repeated) <= 30 * len(w) and not (left < len(w) and (left < 20 or left < 0.4 * len(w))):
            out.append(cut(d, gone))
    return out


def components(sets, links):
    root = {x: x for x in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        root[find(a)] = find(b)
    return {x: find(x) for x in sets}


def line_dedup(docs):
    clean = lambda x: re.sub(r"[\x09-\x0D\x20]+", " ", x).strip(" ")
    places = sorted((d["doc_id"], i, clean(x)) for d in docs for i, x in enumerate(d["text"].split("\n")))
    grams = {x: {x[i : i + 12] for i in range(max(1, len(x) - 11))} for _, _, x in places if x}
    owners, links = defaultdict(list), []
    for x, mine in grams.items():
        for o, n in Counter(o for g in mine for o in owners[g]).items():
            if 5 * n >= 4 * (len(mine) + len(grams[o]) - n):
                links.append((x, o))
        for g in mine:
            owners[g].append(x)
    root, taken, gone = components(grams, links), set(), defaultdict(set)
    for doc, i, x in places:
        if x and root[x] in taken:
            gone[doc].add(i)
        elif x:
            taken.add(root[x])
    return [d for d in (cut(d, gone[d["doc_id"]]) for d in docs) if d["text"].strip(SPACE)]


def near(docs):
    prints = {}
    for d in docs:
        w = d["text"].encode().lower().split()
        grams = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
        prints[d["doc_id"]] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in grams) > len(grams))
    root = components(prints, [(i, j) for i in prints for j in prints if i < j and (prints[i] ^ prints[j]).bit_count() <= 3])
    first = {}
    for i in sorted(prints):
        first.setdefault(root[i], i)
    return [d for d in docs if d["doc_id"] in first.values()]


def coverage(doc, item):
    """The share of the item's tokens under greedy tiles of five tokens or more, each the longest that is left."""
    doc, item, marked = list(doc), list(item), 0
    while True:
        best, row = (0, 0, 0), [0] * (len(item) + 1)
        for i, t in enumerate(doc):
            row = [0] + [row[j] + 1 if t is not None and t == item[j] else 0 for j in range(len(item))]
            n = max(row)
            if n > best[0]:
                best = (n, i, row.index(n) - 1)
        n, i, j = best
        if n < 5:
            return marked / max(1, len(item))
        doc[i - n + 1 : i + 1], item[j - n + 1 : j + 1] = [None] * n, [None] * n
        marked += n


def decontaminated(docs, items):
    parts = [re.findall(r"\w+", (b["text"] or "").lower()) for b in items]
    seeds = [{tuple(p[i : i + 5]) for i in range(len(p) - 4)} for p in parts]
    out = []
    for d in docs:
        t = re.findall(r"\w+", d["text"].lower())
        own = {tuple(t[i : i + 5]) for i in range(len(t) - 4)}
        if not any(own & s and coverage(t, p) >= 0.6 for p, s in zip(parts, seeds, strict=True)):
            out.append(d)
    return out


def test_run_against_slow_stages(spark, tmp_path):
    import corpus_pipeline
    from spriteloom.llm import oracles

    docs = pq.read_table(f"{DATA}/documents.parquet").to_pylist()
    # copies under other line breaks, which line dedup leaves to the near-duplicate stage
    docs += [d | {"doc_id": 10_000 + d["doc_id"], "text": d["text"].replace("\n", " ")} for d in docs[:60] if d["text"].count("\n") > 2]
    pq.write_table(pa.Table.from_pylist(docs, pq.read_schema(f"{DATA}/documents.parquet")), tmp_path / "documents.parquet")
    shutil.copy(f"{DATA}/benchmark.parquet", tmp_path)
    stages = [docs]
    for stage in (quality, line_dedup, near, lambda d: decontaminated(d, pq.read_table(f"{DATA}/benchmark.parquet").to_pylist())):
        stages.append(stage(stages[-1]))
    # every stage has something to do here
    assert len(stages[1]) < len(docs) and len(stages[3]) < len(stages[2]) and len(stages[4]) < len(stages[3])
    texts = {d["doc_id"]: d["text"] for d in stages[1]}
    assert any(d["text"] != texts[d["doc_id"]] for d in stages[2])
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(stages[-1]))
    names = ["doc_id", "source", "size", "source_size", "target", "taken"]
    want = con.execute(f"SELECT {', '.join(names)} FROM ({oracles.MIXTURE}) ORDER BY doc_id").fetchall()
    got = corpus_pipeline.run(spark, f"file://{tmp_path}")
    assert got.columns == names
    assert sorted(tuple(r) for r in got.collect()) == want


def test_run_on_empty_and_odd_tables(spark, tmp_path):
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long, id string, row string, text_hash string"
    good = " ".join(f"word{i} of" for i in range(40))
    odd = [(None, None), (None, good), (None, good), (7, good + " the end"), (7, "\n".join([good.upper(), "", " \t"])), (8, ""), (9, "a" * 100_000)]
    for name, rows in (("empty", []), ("odd", odd)):
        spark.createDataFrame([(i, t, None, None, len(t or ""), "?", "?", "?") for i, t in rows], schema).write.parquet(f"file://{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([(1, None), (2, "")], "item_id long, text string").write.parquet(f"file://{tmp_path}/{name}/benchmark.parquet")
        got = corpus_pipeline.run(spark, f"file://{tmp_path}/{name}").collect()
        assert all(r["source"] is None and r["size"] > 0 for r in got)
        # the copy without a doc_id goes by its lines; the line in capitals is another one
        assert len(got) == {"empty": 0, "odd": 2}[name]
