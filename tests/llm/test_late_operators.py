"""Hard negatives, removal of repeated strings and the Merkle manifest against brute force on small tables."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lithic.llm import hard_negatives, merkle, suffix_dedup

SF = "/root/testdata/sf0.001"


# op11


def negatives(rows, every=100, positives=5, negatives=10, low=30, high=90):
    """From the definition: every pair scored, sorted lists read from the top."""
    real = [(i, lab, [int(np.floor(256 * x)) for x in v]) for i, lab, v in rows if i is not None and lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for n, (i, lab, v) in enumerate(real):
        if i % every:
            continue
        scored = sorted((-dot(v, w), j, other) for m, (j, other, w) in enumerate(real) if m != n)
        for s, j, _ in [x for x in scored if x[2] == lab][:positives]:
            fit = [x for x in scored if x[2] != lab and low * -s <= 100 * -x[0] <= high * -s][:negatives]
            out += [(i, j, r, x[1], -s, -x[0]) for r, x in enumerate(fit, 1)]
    return sorted(out)


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, label int, embedding array<float>, rank string, shard int").repartition(3)


def test_hard_negatives(spark):
    draw = random.Random(4)
    rows = [(i, draw.randrange(3) if i % 11 else None, [round(draw.gauss(0.3, 1), 1) for _ in range(4)]) for i in range(150)]
    rows += [(0, 1, [1.0, 1.0, 0.0, 0.0])] * 3 + [(50, 1, [1.0, 1.0, 0.0, 0.0]), (200, 1, [2.0]), (300, 2, []), (100, 0, [-1.0, -2.0, -3.0, 0.5]), (400, 2, None), (500, 1, [1.0, None]), (600, 1, [float("nan")]), (None, 1, [1.0])]
    want = negatives(rows, every=50)
    assert len(want) > 100
    got = sorted(map(tuple, hard_negatives.mine(vectors(spark, rows), every=50).collect()))
    assert got == want
    assert sorted(map(tuple, hard_negatives.mine(vectors(spark, rows), every=50, positives=2, negatives=3, low=10, high=70).collect())) == negatives(rows, 50, 2, 3, 10, 70)


def test_hard_negatives_edges(spark, monkeypatch):
    assert hard_negatives.mine(vectors(spark, []).limit(0)).count() == 0
    alone = [(0, 1, [1.0, 2.0]), (1, 1, [1.0, 1.0])]
    assert hard_negatives.mine(vectors(spark, alone)).count() == 0  # a single label
    assert hard_negatives.mine(vectors(spark, [(1, 1, [1.0]), (2, 2, [1.0])])).count() == 0  # no anchor
    ties = [(100 * k, k % 2, [1.0, 0.5]) for k in range(5)] + [(k, 2, [0.5, 0.25]) for k in range(1, 40)]
    monkeypatch.setattr(hard_negatives, "SHARD", 4)
    monkeypatch.setattr(hard_negatives, "FAN", 2)
    monkeypatch.setattr(hard_negatives, "BLOCK_BYTES", 32)
    assert sorted(map(tuple, hard_negatives.mine(vectors(spark, ties)).collect())) == negatives(ties)
    moved = spark.createDataFrame([(7, 9), (8, 9), (14, None)], "vec_id long, label int").select(hard_negatives.relabelled().alias("x")).collect()
    assert [r.x for r in moved] == [0, 9, None]


# op12


def removed(rows, length):
    """(n_bytes, removed spans, kept) of each row, from a set of all strings read so far."""
    bodies, seen, out = [(t or "").encode() for _, t in rows], set(), {}
    for i in sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i)):
        body, gone = bodies[i], bytearray(len(bodies[i]))
        for a in range(len(body) - length + 1):
            string = body[a : a + length]
            if string in seen:
                gone[a : a + length] = b"\1" * length
            seen.add(string)
        begins = [a for a in range(len(body)) if gone[a] and not (a and gone[a - 1])]
        ends = [a + 1 for a in range(len(body)) if gone[a] and not (a + 1 < len(body) and gone[a + 1])]
        out[i] = (rows[i][0], len(body), list(zip(begins, ends, strict=True)), bytes(b for b, g in zip(body, gone, strict=True) if not g))
    return sorted(out.values(), key=str)


def read_back(spark, tmp_path, rows, parts):
    """The rows as a table of files, and in the order in which it is read."""
    df = spark.createDataFrame([(a, b, i, b"k") for i, (a, b) in enumerate(rows)], "doc_id long, text string, size long, body binary")
    df = df.coalesce(1) if parts == 1 else df.repartition(parts)
    df.write.parquet(str(tmp_path / "d"))
    df = spark.read.parquet(str(tmp_path / "d"))
    return df, [(r.doc_id, r.text) for r in df.collect()]


def corpus(seed, n):
    draw = random.Random(seed)
    words = ["".join(draw.choice("abcdefgh é漢\x00") for _ in range(draw.randint(2, 9))) for _ in range(250)]
    text = lambda k: " ".join(draw.choice(words) for _ in range(k))
    base, passages = [text(draw.randint(5, 150)) for _ in range(30)], [text(40) for _ in range(4)]
    odd = ["", None, "a" * 500, "ab" * 400, "x", passages[0][:100], "y" + passages[0][:99], text(60)]

    def near(t):
        w = t.split(" ")
        for _ in range(3):
            w[draw.randrange(len(w))] = draw.choice(words)
        return " ".join(w)

    kinds = [lambda: draw.choice(base), lambda: near(draw.choice(base)), lambda: f"{text(20)} {draw.choice(passages)} {text(20)}", lambda: draw.choice(odd), lambda: text(60)]
    return [(draw.choice([i, i, i, 7, None]), draw.choice(kinds)()) for i in range(n)]


@pytest.mark.parametrize("parts, length, small", [(1, 100, False), (5, 100, True), (3, 24, True)])
def test_suffix_dedup(spark, tmp_path, monkeypatch, parts, length, small):
    """Also with runs, pieces and ranges so small that equal k-grams lie on both sides of splitters."""
    if small:
        for name, value in {"RUN": 50, "CHUNK": 20, "RANGE": 100, "PIECE": 300}.items():
            monkeypatch.setattr(suffix_dedup, name, value)
    df, rows = read_back(spark, tmp_path, corpus(parts, 160), parts)
    got = sorted(((r.doc_id, r.n_bytes, [(s.begin, s.end) for s in r.removed], bytes(r.kept)) for r in suffix_dedup.remove_repeats(df, length).collect()), key=str)
    assert got == removed(rows, length)
    assert sum(len(x[2]) for x in got) > 50


def test_suffix_dedup_edges(spark, tmp_path):
    df, rows = read_back(spark, tmp_path, [(2, "q" * 99), (1, "q" * 99), (3, None), (None, "")], 2)
    assert suffix_dedup.remove_repeats(df.limit(0)).count() == 0
    assert sorted((r.n_bytes, len(r.removed)) for r in suffix_dedup.remove_repeats(df).collect()) == [(0, 0), (0, 0), (99, 0), (99, 0)]
    draw = random.Random(1)
    long = "".join(draw.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(300_000))
    df, rows = read_back(spark, tmp_path / "long", [(5, long), (1, long[100_000:250_000] + "!"), (9, long)], 1)
    got = {r.doc_id: [(s.begin, s.end) for s in r.removed] for r in suffix_dedup.remove_repeats(df).collect()}
    assert got == {1: [], 5: [(100_000, 250_000)], 9: [(0, 300_000)]}
    flat, _ = read_back(spark, tmp_path / "flat", [(1, "e" * 150_000 + "!"), (5, "e" * 300_000)], 1)
    assert {r.doc_id: [(s.begin, s.end) for s in r.removed] for r in suffix_dedup.remove_repeats(flat).collect()} == {1: [(1, 150_000)], 5: [(0, 300_000)]}
    with pytest.raises(ValueError):
        suffix_dedup.remove_repeats(df, 8)
    with pytest.raises(Exception, match="not read alike"):
        suffix_dedup.remove_repeats(df.withColumn("text", F.concat("text", F.current_timestamp().cast("string")))).collect()


def test_loser_tree_reads_no_known_prefix():
    """Merged order and shared lengths of front-coded pieces; each byte of a prefix is compared once along a run of equal prefixes."""
    draw = np.random.default_rng(2)
    width = 40
    pieces, everything = [], []
    for k in range(7):
        rows = draw.integers(97, 99, (60 * k, width)).astype(np.uint8)
        rows[:, :25] = 97
        rows = np.unique(rows, axis=0) if len(rows) else rows
        fields = {n: np.arange(len(rows)) for n, _ in suffix_dedup._FIELDS}
        pieces.append(suffix_dedup.Piece(suffix_dedup.packed(rows, {n: v % 200 for n, v in fields.items()}), width))
        everything += [r.tobytes() for r in rows]
    tree = suffix_dedup.LoserTree(pieces)
    before, got = b"", []
    for _, _, suffix, shared in tree:
        same = next((i for i, (a, b) in enumerate(zip(before, suffix, strict=False)) if a != b), min(len(before), width))
        assert shared == same
        got.append(suffix)
        before = suffix
    assert got == sorted(everything)
    assert tree.compared < 15 * len(got)  # the 25 common bytes alone would be more


# op13


def manifest(rows, fanout, lie=lambda r: r):
    """From the definition: levels as lists, a proof walked up level by level."""
    h = lambda parts: hashlib.sha256("".join(parts).encode()).hexdigest()
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    own = lambda r: h([part(r[k]) for k in ("doc_id", "source", "lang", "n_chars", "text")])

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([h(out[-1][i : i + fanout]) for i in range(0, len(out[-1]), fanout)])
        return out

    def path(tree, at):
        for level in tree[:-1]:
            first = at - at % fanout
            run = level[first : first + fanout]
            yield at - first, run
            at //= fanout

    langs = sorted({r["lang"] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        leaves = sorted((r for r in rows if r["lang"] == lang), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, own(r)))
        trees[lang] = (leaves, levels([own(r) for r in leaves]))
    top = levels([trees[x][1][-1][0] for x in langs])
    out = []
    for at_lang, lang in enumerate(langs):
        leaves, tree = trees[lang]
        for at, r in enumerate(leaves):
            siblings, folded = [], own(lie(r))
            for place, run in [*path(tree, at), *path(top, at_lang)]:
                siblings += run[:place] + run[place + 1 :]
                folded = h([*run[:place], folded, *run[place + 1 :]])
            out.append((r["doc_id"], own(r), tree[-1][0], top[-1][0], h(siblings), folded, folded == top[-1][0]))
    return sorted(out, key=str)


def tampered(r):
    hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
    return r | {"n_chars": r["n_chars"] + 1} if hit and r["n_chars"] is not None else r


SHAPE = "doc_id long, source string, lang string, n_chars long, text string, hash string, run long"


@pytest.mark.parametrize("fanout, n", [(2, 150), (3, 90), (16, 60), (2, 1)])
def test_merkle_manifest(spark, monkeypatch, fanout, n):
    monkeypatch.setattr(merkle, "RUN", 10)
    monkeypatch.setattr(merkle, "FAN", 3)
    draw = random.Random(fanout)
    lang = lambda: draw.choice(["en", "en", "en", "de", "é", "", None])
    rows = [{"doc_id": draw.choice([i, i, i, 3, None]), "source": draw.choice(["s", None, ""]), "lang": lang(), "n_chars": draw.choice([i, None]), "text": draw.choice([None, "", "漢 x", "same"])} for i in range(n)]
    rows += rows[:5]
    df = spark.createDataFrame([(*r.values(), "h", 3) for r in rows], SHAPE).repartition(4)
    got = sorted(map(tuple, merkle.manifest(df, merkle.tampered(), fanout).collect()), key=str)
    assert got == manifest(rows, fanout, tampered)


def test_merkle_edges(spark):
    empty = spark.createDataFrame([], SHAPE)
    assert merkle.manifest(empty).count() == 0
    one = spark.createDataFrame([(1, "s", "en", 3, "abc", "h", 1)], SHAPE)
    row = merkle.manifest(one).first()
    assert row.leaf == row.subroot == row.root == row.folded_root and row.verified and row.proof_sha256 == hashlib.sha256(b"").hexdigest()
    with pytest.raises(ValueError):
        merkle.manifest(one, fanout=1)


def test_peaks_of_parts_make_the_whole():
    """Stacks fed with parts that are not aligned give few peaks, and these give the root of the whole."""
    for fanout, total, cuts in [(2, 37, (0, 5, 6, 19, 37)), (3, 100, (0, 1, 50, 99, 100)), (5, 26, (0, 26))]:
        leaves = [hashlib.sha256(bytes([i])).digest() for i in range(total)]
        whole = merkle.Mountains(fanout, total)
        for i, leaf in enumerate(leaves):
            whole.push(0, i, leaf)
        assert len(whole.stack) == 1
        merged = merkle.Mountains(fanout, total)
        for a, b in zip(cuts, cuts[1:], strict=False):
            part = merkle.Mountains(fanout, total)
            for i in range(a, b):
                part.push(0, i, leaves[i])
            assert len(part.stack) <= 2 * fanout * len(part.widths)
            for r in part.stack:
                merged.push(*part.nodes[r])
        assert [merged.nodes[r] for r in merged.stack] == [whole.nodes[whole.stack[0]]]


# op2: texts of single characters, words of any length


def test_toxicity_of_digit_tables_and_enormous_words(monkeypatch):
    """Time in proportion to the text where runs of single characters are many; slices change no sum."""
    import time

    import pyarrow as pa

    from lithic.llm import toxicity

    draw = np.random.default_rng(3)
    keys = np.unique(draw.integers(0, 1 << 24, 4000)).astype(np.uint32)
    model = toxicity.Model(keys, draw.normal(size=len(keys)).astype(np.float32), -0.2, 1.0, 0.0)
    table = "1 2 3 4 total "
    began = time.time()
    toxicity.document_margins(pa.array([table * 1000]), model)
    toxicity._scores.clear()
    small = time.time() - began
    began = time.time()
    long = toxicity.document_margins(pa.array([table * 430_000]), model)  # 6 MB
    assert time.time() - began < max(5, 3000 * small)
    toxicity._scores.clear()
    assert long[0] == pytest.approx(toxicity.document_margins(pa.array([table * 3]), model)[0])
    texts = pa.array(["x" * 5000 + " " + "abc" * 900, "a b c d " * 300 + "word", "", "one two"])
    toxicity._scores.clear()
    one = toxicity.document_margins(texts, model)
    monkeypatch.setattr(toxicity, "SLICE", 97)
    toxicity._scores.clear()
    assert toxicity.document_margins(texts, model) == pytest.approx(one)


# op3: forms of calls, fields besides


def test_tool_chat_keeps_all_fields(spark):
    import json

    from lithic.llm import tool_chat

    calls = [
        {"id": "a", "type": "function", "function": {"name": "search", "arguments": '{"query":"q","limit":3}', "strict": True}},
        {"id": "b", "function": {"name": "lookup", "arguments": {"key": "@a"}}},
        {"id": "c", "name": "lookup", "arguments": '{"key":"k"}', "function": "odd", "meta": {"z": 1, "a": [None, 2.5]}},
        {"id": "d", "name": "lookup", "arguments": "no object"},
        {"id": 7, "function": {"name": "weather"}},
        "not an object",
    ]
    rows = [
        (1, 0, "assistant", json.dumps({"tool_calls": calls})),
        (1, 1, "tool", json.dumps({"tool_call_id": "a", "content": [{"type": "text", "text": "x"}, 2], "is_error": False, "name": "search", "role": "tool"})),
        (1, 2, "tool", json.dumps({"tool_call_id": "b", "content": {"b": 1, "a": None}})),
        (1, 3, "tool", json.dumps({"tool_call_id": "c"})),
        (1, 4, "tool", json.dumps({"tool_call_id": 7, "content": "mild"})),
    ]
    got = tool_chat.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    made = {r.part: r for r in got if r.kind == "call"}
    told = {p: json.loads(r.json) for p, r in made.items()}
    assert told[0] == {"arguments": {"limit": 3, "query": "q"}, "function": {"strict": True}, "id": "a", "name": "search", "type": "function"}
    assert made[0].valid and made[0].linked and made[0].json == '{"arguments":{"limit":3,"query":"q"},"function":{"strict":true},"id":"a","name":"search","type":"function"}'
    assert told[1] == {"arguments": {"key": "@a"}, "id": "b", "name": "lookup"} and made[1].level == 2 and made[1].valid
    assert told[2] == {"arguments": {"key": "k"}, "function": "odd", "id": "c", "meta": {"a": [None, 2.5], "z": 1}, "name": "lookup"}
    assert made[3].problems == ["arguments are not an object", "key is missing"] and told[3]["arguments"] == "no object"
    assert made[4].problems == ["city is missing"] and made[4].call_id == "7" and made[4].linked
    assert made[5].problems == ["no name"]
    results = {r.call_id: r.json for r in got if r.kind == "result"}
    assert results["a"] == '{"content":[{"text":"x","type":"text"},2],"is_error":false,"name":"search","role":"tool","tool_call_id":"a"}'
    assert results["b"] == '{"content":{"a":null,"b":1},"role":"tool","tool_call_id":"b"}'
    assert results["c"] == '{"content":null,"role":"tool","tool_call_id":"c"}' and results["7"] == '{"content":"mild","role":"tool","tool_call_id":"7"}'


def test_tool_chat_many_calls(spark):
    """A generated table of 100,000 calls in one conversation, each waiting for the one before it in chains of ten."""
    from lithic.llm import tool_chat

    n = F.col("id")
    call = F.format_string('{"tool_calls":[{"id":"c%d","name":"lookup","arguments":{"key":"%s"}}]}', n, F.when(n % 10 == 0, F.lit("k")).otherwise(F.concat(F.lit("@c"), (n - 1).cast("string"))))
    answer = F.format_string('{"tool_call_id":"c%d","content":"r%d"}', n, n)
    base = spark.range(100_000)
    chat = base.select(F.lit(1).alias("conv_id"), (100_000 - n).alias("turn"), F.lit("assistant").alias("role"), call.alias("text")).unionByName(base.select(F.lit(1).alias("conv_id"), (200_000 - n).alias("turn"), F.lit("tool").alias("role"), answer.alias("text")))
    got = tool_chat.link(chat).groupBy("kind").agg(F.count("*").alias("n"), F.count_if("linked").alias("linked"), F.max("level").alias("most"), F.sum("level").alias("levels")).collect()
    assert sorted(map(tuple, got)) == [("call", 100_000, 100_000, 18, 900_000), ("result", 100_000, 100_000, 19, 1_000_000)]


# op10: rows that share an id


def test_line_dedup_counts_documents(spark):
    """A short line of seven documents stays, in however many rows and slices they come; of eight it goes."""
    from lithic.llm import line_templates

    draw = random.Random(5)
    own = lambda: " ".join("".join(draw.choice("abcdefgh") for _ in range(6)) for _ in range(12))
    rows = [(i % 7, f"seven of us\n{own()}") for i in range(40)] + [(100 + i, f"{own()}\neight of us") for i in range(8)]
    got = line_templates.report(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()
    assert sum("seven of us" in r.text for r in got) == 40
    assert [r.doc_id for r in got if "eight of us" in r.text] == [100]
