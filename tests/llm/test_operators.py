"""The corpus operators against brute force on small tables with nulls, ties, repeats and clashing columns."""

import hashlib
import json
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lithic.llm import common, fingerprints, jaccard_join, line_templates, mixing, piece_codec, sharding, tool_chat, topk, toxicity, url_filter, wordhash
from lithic.llm.queries import piece_model

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")
BASE = " ".join(f"w{i}" for i in range(60))
TEXTS = [
    BASE, BASE, BASE + " more", BASE.upper(), "x " + BASE, None, "", "  \n\t", "one two", "One  TWO", "a b c d e f", " ".join(f"v{i}" for i in range(3000)),
    "Ä é 漢字 𝄞 ▁ \x00 end\n\nline  two \r\n", BASE.replace("w30", "z"), "tail",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", f"s{i % 3}" if i % 5 else None, 1, 7, "k") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size long, shard string").repartition(3)


def shingles(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def test_fingerprints(docs):
    got = {r.doc_id: r for r in fingerprints.compare_edits(docs).collect()}
    assert len(got) == len(TEXTS)
    texts = [t or "" for t in TEXTS]
    for i, text in enumerate(texts):
        other = texts[i - 1]  # of 0, the last
        third = len(text) // 3
        edited = text[: len(text) - third] + other[:third]
        assert got[i].n_chars == len(text) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
    assert got[0].fingerprint == got[1].fingerprint and got[1].near_next == 1 and got[3].near_next > 0.8
    a, b = fingerprints.from_text(got[0].fingerprint), fingerprints.from_text(got[11].fingerprint)
    assert fingerprints.containment(a, fingerprints.merge(a, b)) == 1


def test_fingerprints_by_hand(docs):
    """Sketches and likenesses from the hashes of single shingles."""
    limit = int(fingerprints.FRACTION * 2**64)

    def sketch(text):
        own = sorted({int(wordhash.text_shingles(wordhash.pa.array([" ".join(s)]))[0][0]) for s in shingles(text)})
        return [h for h in own if h < limit] or own[:1]

    def near(a, b):
        return float(not a and not b) if not a or not b else len(set(a) & set(b)) / min(len(a), len(b))

    texts = [t or "" for t in TEXTS]
    got = {r.doc_id: r for r in fingerprints.compare_edits(docs).collect()}
    for i, text in enumerate(texts):
        after = texts[i - 1]
        own, edited = sketch(text), sketch(text[: len(text) - len(text) // 3] + after[: len(text) // 3])
        assert fingerprints.from_text(got[i].fingerprint).tolist() == own and fingerprints.from_text(got[i].edited_fingerprint).tolist() == edited
        assert got[i].near_edited == near(own, edited) and got[i].near_next == near(own, sketch(after))
    one, two = (np.array(sketch(t), np.uint64) for t in (BASE, "a b c d e"))
    assert fingerprints.merge(one, two).tolist() == sketch(BASE + " a b c d e")[:0] + sorted({*[h for h in one.tolist() if h < limit], *[h for h in two.tolist() if h < limit]})


def test_fingerprints_edges(spark, docs):
    assert fingerprints.compare_edits(docs.limit(0)).count() == 0
    alone = fingerprints.compare_edits(docs.where("doc_id = 0")).collect()
    assert len(alone) == 1 and alone[0].near_next == 1
    nulls = spark.createDataFrame([(None, "a b"), (1, "c d e"), (1, "c d e")], "doc_id long, text string")
    assert fingerprints.compare_edits(nulls).count() == 3


def thue_morse(a, b, n=4096):
    return [a if i.bit_count() % 2 else b for i in range(n)]


def test_word_hashes(spark):
    """Words and lines whose polynomials modulo 2 ** 64 are equal for any base."""
    pairs = [("".join(thue_morse(*ab, n)), "".join(thue_morse(*ab[::-1], n))) for ab in ("ab", "éx") for n in (64, 1024, 4096)]
    hashes, first = wordhash.text_shingles(wordhash.pa.array([w for pair in pairs for w in pair] + ["a", "b", "ab", "ba"]))
    assert len(set(hashes.tolist())) == len(hashes) == 2 * len(pairs) + 4
    one, two = pairs[1]
    rows = spark.createDataFrame([(1, one), (2, two), (3, one)], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard_join.join(rows).collect()} == {1: 1, 2: 2, 3: 1}
    assert {r.doc_id: r.near_next for r in fingerprints.compare_edits(rows).collect()} == {1: 1, 2: 0, 3: 0}
    lines = spark.createDataFrame([(1, "x y " + " ".join(thue_morse("a", "b"))), (2, "x y " + " ".join(thue_morse("b", "a")))], "doc_id long, text string")
    assert [r.n_dropped for r in line_templates.report(lines).collect()] == [0, 0]
    long = "w" * 300_000
    hashes, _ = wordhash.text_shingles(wordhash.pa.array([long, long.upper(), long + "w", "w" * 299_999 + "v"]))
    assert hashes[0] == hashes[1] and len(set(hashes.tolist())) == 3


def test_toxicity(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    bad = ["stupid idiot", "you are a moron", "trash and scum"]
    rows = [(10_000 + i, f"filler words number {i} {bad[i % 3] if i % 2 else 'nice day here'} end", i % 2) for i in range(600)]
    more = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    docs = docs.select("doc_id", "text").unionByName(more.select("doc_id", "text"))
    labels = labels.select("doc_id", "toxic").unionByName(more.select("doc_id", "toxic"))
    got = toxicity.score(docs, labels).join(labels, "doc_id").where("held_out").collect()
    right = sum(r.predicted == r.toxic for r in got) / len(got)
    assert right > 0.95 and all(0 <= r.score <= 1 for r in got)
    model = toxicity.train(docs, labels)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "hello stuupid one"), (3, "hello stuupid one")], "doc_id long, text string")
    scores = [r.score for r in toxicity.score(odd, labels, model=model).orderBy("doc_id").collect()]
    assert len(scores) == 4 and scores[0] == scores[1] < 0.5 and scores[2] == scores[3]
    assert toxicity.score(odd, labels.limit(0)).where("predicted = 1").count() == 0
    assert toxicity.score(odd.limit(0), labels, model=model).count() == 0


def test_tool_chat(spark):
    call = '{"tool_calls":[{"id":"%s","name":"%s","arguments":%s}]}'
    rows = [
        (1, 0, "user", 'hi "there"'), (1, 1, "assistant", call % ("b", "lookup", '{"key":"k","after":"@a"}')), (1, 2, "tool", '{"tool_call_id":"b","content":"2"}'),
        (1, 3, "assistant", call % ("a", "search", '{"query":"q","limit":"x"}')), (1, 4, "tool", '{"tool_call_id":"a","content":"1"}'), (1, 5, "tool", '{"tool_call_id":"zz","content":"?"}'),
        (2, 0, "assistant", "{broken"), (2, 1, None, None), (None, None, "assistant", call % ("c", "nope", "{}")),
    ]
    messages = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("level", F.lit("clash"))
    got = tool_chat.link(messages).collect()
    assert len(got) == len(rows)
    by = {(r.kind, r.call_id): r for r in got if r.call_id}
    assert by["call", "a"].position < by["result", "a"].position < by["call", "b"].position < by["result", "b"].position
    assert by["call", "b"].linked and by["call", "b"].valid and not by["result", "zz"].linked
    assert by["call", "a"].problems == ["limit is not a number"] and by["call", "c"].problems == ["unknown tool nope"]
    assert by["call", "a"].json == '{"arguments":{"limit":"x","query":"q"},"id":"a","name":"search"}'
    assert tool_chat.link(messages.limit(0)).count() == 0


def test_tool_chat_types(spark):
    call = '{"tool_calls":[{"id":"%s","name":"search","arguments":%s}]}'
    arguments = ['{"query":5}', '{"query":"5","limit":"5"}', '{"limit":5.5,"query":"5"}', '{"query":null,"limit":true}', '{"query":{"b":[1,{"y":null,"x":"é\\n"}],"a":-2}}', '["@a0"]', '{"query":"q","query":"r"}', '{"query":"q","limit":1e2}']
    rows = [(1, i, "assistant", call % (f"a{i}", a)) for i, a in enumerate(arguments)] + [(1, 99, "assistant", '{"tool_calls":[{"id":"a99","name":"search"}]}')]
    got = {r.call_id: r for r in tool_chat.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert len(got) == len(rows) and {r.kind for r in got.values()} == {"call"}
    wrong = {k: r.problems for k, r in got.items()}
    assert wrong["a0"] == ["query is not a string"] and wrong["a1"] == ["limit is not a number"] and wrong["a2"] == [] and wrong["a3"] == ["limit is not a number", "query is not a string"]
    assert wrong["a4"] == ["query is not a string"] and wrong["a5"] == ["arguments are not an object", "query is missing"] and wrong["a6"] == wrong["a7"] == [] and wrong["a99"] == ["query is missing"]
    written = {k: r.json.removeprefix('{"arguments":').partition(',"id":"a')[0] for k, r in got.items()}
    assert [written[f"a{i}"] for i in range(6)] == ['{"query":5}', '{"limit":"5","query":"5"}', '{"limit":5.5,"query":"5"}', '{"limit":true,"query":null}', '{"query":{"a":-2,"b":[1,{"x":"é\\n","y":null}]}}', '["@a0"]']
    assert written["a6"] == '{"query":"r"}' and written["a7"] == '{"limit":100.0,"query":"q"}' and written["a99"] == "{}"


def test_tool_chat_mixed(spark):
    calls = '"tool_calls":[{"id":"a","name":"lookup","arguments":{"key":"k"}},{"id":"b","name":"lookup","arguments":{"key":"l"}}]'
    rows = [(1, 0, "assistant", '{"role":"assistant","content":"Let me \\"look\\"",%s,"meta":{"z":1,"a":[2]}}' % calls), (1, 1, "assistant", '{%s,"content":null,"role":"assistant"}' % calls.replace('"a"', '"c"').replace('"b"', '"d"')), (1, 2, "user", "hi")]
    got = sorted(tool_chat.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect(), key=lambda r: r.position)
    assert [(r.kind, r.turn, r.part, r.call_id) for r in got] == [("message", 0, 0, None), ("call", 0, 0, "a"), ("call", 0, 1, "b"), ("call", 1, 0, "c"), ("call", 1, 1, "d"), ("message", 2, 0, None)]
    assert got[0].json == '{"content":"Let me \\"look\\"","meta":{"a":[2],"z":1},"role":"assistant"}' and got[5].json == '{"content":"hi","role":"user"}'


def test_tool_chat_chains(spark):
    call = '{"tool_calls":[{"id":"%s","name":"lookup","arguments":{"key":"k",%s}}]}'
    waits = {f"c{i}": [f"c{i - 1}"] if i else [] for i in range(150)}  # a chain of 150 calls
    waits |= {"x": ["y"], "y": ["x"], "z": ["y", "c3"], "s": ["s"], "d0": ["c1"], "d1": ["d0", "c5"], "d2": ["d0", "d1", "gone"], "d3": ["d2", "c149"]}
    rows = []
    for turn, (name, on) in enumerate(reversed(waits.items())):
        rows += [(1, 2 * turn, "assistant", call % (name, ",".join(f'"a{k}":"@{w}"' for k, w in enumerate(["none", *on])))), (1, 2 * turn + 1, "tool", '{"tool_call_id":"%s","content":"r"}' % name)]
    got = tool_chat.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    want = {}
    for name in [*(f"c{i}" for i in range(150)), "d0", "d1", "d2", "d3"]:
        want[name] = max([want[w] + 2 for w in waits[name] if w in want], default=0)
    assert {r.call_id: r.level for r in got if r.kind == "call" and r.linked} == want
    order = [(r.kind, r.call_id) for r in sorted(got, key=lambda r: r.position)]
    at = {key: i for i, key in enumerate(order)}
    assert all(at["result", w] < at["call", name] for name in want for w in waits[name] if w in want)
    assert {name for _, name in order[-8:]} == {"x", "y", "z", "s"}


def test_toxicity_kernel():
    """The machine's kernel against its definition, over words, phrases and other letters."""
    marks = toxicity._Landmarks([b"idiot", b"clear off", "дурак".encode()])
    string = lambda w: [0, *toxicity._characters(np.frombuffer(w, np.uint8))[0].tolist(), 0]
    size = lambda w: float(toxicity._norm(np.array([len(string(w))]))[0])
    for word in (b"idiot", b"IDIOT!", b"i.d.i.o.t", b"clear off", b"clearoff", b"x", "дурак".encode(), "ду-рак".encode(), "漢字𝄞é".encode()):
        want = [toxicity.naive_kernel(string(word), string(m)) / max(size(word) * size(m), 1e-9) for m in marks.found]
        assert marks.kernel([word])[0] == pytest.approx(want)
    assert marks.kernel([b"i.d.i.o.t"])[0][0] > 0 and len(set(string("дурак".encode()))) > 4
    draw = np.random.default_rng(4)
    weights = draw.normal(size=3)
    model = toxicity.Model(marks.keys, marks.fold(weights), 0.25, 1.0, 0.0, True)
    words = ["so", "clear", "off", "idiot", "дурак"]
    found = toxicity.document_margins(toxicity.pa.array([" ".join(words), "\n".join(words), "", None]), model)
    strings = [w.encode() for w in [*words, *map(" ".join, zip(words[:-1], words[1:], strict=True))]]
    assert found[0] == pytest.approx((marks.kernel(strings) @ weights).max() + 0.25, abs=1e-5) and found[1] == pytest.approx(found[0])
    assert found[2] == found[3] == -1


def test_toxicity_phrases():
    """Two harmless words that insult when they stand together, and labels that are noise."""
    draw = random.Random(1)
    known = ["w" + "".join(draw.choice("abcdehilmnoprstu") for _ in range(draw.randrange(2, 8))) for _ in range(500)]

    def text(toxic):
        words = [w for w in draw.choices(known, k=draw.randrange(20, 60))]
        for w in ("clear", "off", "clear", "off"):
            words.insert(draw.randrange(len(words)), w)
        words = [w for i, w in enumerate(words) if w != "off" or not i or words[i - 1] != "clear"]
        return " ".join(words[:9] + ["clear", "off"] * toxic + words[9:])

    labels = [i % 2 for i in range(500)]
    texts = [text(y) for y in labels]
    batch = toxicity.pa.RecordBatch.from_arrays([toxicity.pa.array(labels[:400], toxicity.pa.int32()), toxicity.pa.array(texts[:400])], ["toxic", "text"])
    bags = toxicity.pa.Table.from_batches(list(toxicity._bags(iter([batch]))))
    model = toxicity.fit(bags["toxic"], bags["words"])
    got = model.probability(toxicity.document_margins(toxicity.pa.array(texts[400:]), model)) >= toxicity.THRESHOLD
    assert model.phrases and (got == np.array(labels[400:], bool)).mean() >= 0.95


def test_toxicity_edges(spark):
    """Whole ids of another type, clashing columns, nulls, a very long text."""
    draw = random.Random(2)
    plain = lambda n: " ".join("".join(draw.choices("abenorstu", k=6)) for _ in range(n))
    rows = [(i, f"{plain(40_000 if i == 4 else 12)} {'idiot' if i % 2 else 'nice'} end", i % 2) for i in range(300)]
    docs = spark.createDataFrame([(r[0], r[1], "x", 1.0) for r in rows] + [(None, None, "x", 1.0)], "doc_id int, text string, words string, _score double")
    labels = spark.createDataFrame([(r[0], r[2], "x") for r in rows] + [(None, 1, "x"), (3, None, "x")], "doc_id int, toxic long, text string")
    got = toxicity.score(docs, labels).collect()
    assert len(got) == 301 and all(r.predicted == r.doc_id % 2 for r in got if r.doc_id is not None)
    kept = toxicity.score(docs, labels, keep=True)
    assert kept.columns == ["doc_id", "text", "words", "_score"] and kept.count() == 301


def linked_by_hand(rows):
    """(conv, turn, part, kind, id) of each row in order, and which calls and results are linked, one conversation at a time."""
    out, linked = [], {}
    for conv in {r[0] for r in rows}:
        calls, results, items = {}, {}, []
        for _, turn, role, text in (r for r in rows if r[0] == conv):
            body = json.loads(text) if text.startswith("{") else {}
            if role == "assistant" and "tool_calls" in body:
                items += [("call", turn, part, c["id"], {v[1:] for v in c["arguments"].values() if v.startswith("@")}) for part, c in enumerate(body["tool_calls"])]
            else:
                items.append(("result", turn, 0, body["tool_call_id"], None) if role == "tool" and "tool_call_id" in body else ("message", turn, 0, None, None))
        for kind, turn, part, name, waits in sorted(items, key=lambda i: i[1:3]):
            if kind == "call":
                calls.setdefault(name, ((turn, part), waits))
            elif kind == "result":
                results.setdefault(name, []).append((turn, part))
        settled = {}
        while True:
            more = {n: (own, {w for w in waits if w in calls}) for n, (own, waits) in calls.items() if n not in settled and all(w in settled for w in waits if w in calls)}
            for n, (own, waits) in more.items():
                settled[n] = (max([settled[w][0] + 2 for w in waits], default=0), max([own, *(x for w in waits for x in (settled[w][1], *results.get(w, [])))]))
            if not more:
                break
        for kind, turn, part, name, _ in items:
            level, place = (0, (turn, part)) if kind == "message" else settled.get(name, (None, None)) if name in calls else (0, (turn, part))
            lost = level is None
            place = (1, 0, 0) if lost else (0, *max(place, (turn, part)))
            out.append(((conv, place, 3 if lost else level + (kind == "result" and name in calls), kind != "message", turn, part), (conv, turn, part, kind, name)))
            if kind != "message":
                linked[conv, turn, part, kind] = not lost and name in results if kind == "call" else name in calls
    return out, linked


def test_tool_chat_random(spark):
    """Random conversations with waits, cycles, lost results and calls that share identifiers."""
    draw = random.Random(5)
    rows = []
    for conv in range(40):
        size, back = draw.choice([3, 12, 60]), draw.random() < 0.3
        for turn in range(size):
            kind = draw.random()
            if kind < 0.2:
                rows.append((conv, turn, "user", f"say {turn}"))
            elif kind < 0.6:
                made = [{"id": f"c{draw.randrange(size)}", "name": "lookup", "arguments": {"key": "k", **{f"w{k}": f"@c{draw.randrange(size if back else max(1, turn))}" for k in range(draw.randrange(3))}}} for _ in range(draw.randrange(1, 3))]
                rows.append((conv, turn, "assistant", json.dumps({"tool_calls": made})))
            else:
                rows.append((conv, turn, "tool", json.dumps({"tool_call_id": f"c{draw.randrange(size)}", "content": "r"})))
    want, linked = linked_by_hand(rows)
    got = tool_chat.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("position", F.lit(1))).collect()
    assert {(r.conv_id, r.turn, r.part, r.kind): r.linked for r in got if r.kind != "message"} == linked
    assert sum(linked.values()) > 100 and not all(linked.values())
    last = {key for key, _ in want if key[1] == (1, 0, 0)}
    assert last
    for conv in range(40):
        order = [(r.conv_id, r.turn, r.part, r.kind, r.call_id) for r in sorted((r for r in got if r.conv_id == conv), key=lambda r: r.position)]
        expected = sorted((k, v) for k, v in want if k[0] == conv and k not in last)
        assert order[: len(expected)] == [v for _, v in expected]


def test_tool_chat_turns(spark):
    """Without waits rows keep their turns; repeated rows and negative turns stay in order."""
    call = '{"tool_calls":[{"id":"%s","name":"lookup","arguments":{"key":"k"}}]}'
    rows = [(1, -2, "user", "a"), (1, 0, "assistant", call % "a"), (1, 1, "tool", '{"tool_call_id":"a","content":"1"}'), (1, 2, "assistant", "so"), (1, 3, "assistant", call % "b"), (1, 11, "tool", '{"tool_call_id":"b","content":"2"}'), (1, 12, "user", "z")]
    got = tool_chat.link(spark.createDataFrame(rows + rows[3:4], "conv_id long, turn int, role string, text string")).collect()
    assert [r.turn for r in sorted(got, key=lambda r: r.position)] == [-2, 0, 1, 2, 2, 3, 11, 12]


def test_url_filter(spark):
    urls = ["http://Sub.Example.NET/en/1", "https://x.example.net", "x://a.org/fr/casino", "no scheme casino", None, "", "http://a.b/poker?x#y", "http://e.example.com/de/", "http://pokers.b/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("rule", F.lit(1))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages).collect()}
    assert got[0] == ("sub.example.net", "/en/1", "example.net/en/", "allow") and got[1] == ("x.example.net", "", None, "allow")
    assert got[2] == ("a.org", "/fr/casino", "org/fr/", "allow") and got[3] == ("", "", None, "block") and got[4] == got[5] == ("", "", None, "allow")
    assert got[6] == ("a.b", "/poker", None, "block") and got[7][2:] == ("example.com/de/", "block") and got[8][3] == "allow"
    assert url_filter.judge(pages.limit(0)).count() == 0


def test_url_rules(spark):
    paths = """porn xxx adult sex escort casino poker betting viagra cialis warez torrent crack/x/download phishing malware doubleclick adserver banner/ads
        click/track ?utm_medium=affiliate wp-login.php login/redirect cart/checkout search?q=shoes calendar?month=5 calendar?year=1&month=5 setup.exe a/setup.apk?v=1 x.iso""".split()
    pages = spark.createDataFrame([(i, f"http://a.b/{path}") for i, path in enumerate(paths)] + [(99, "http://a.b/setup.exes/research?q=x")], "page_id long, url string")
    got = {r.page_id: (r.verdict, r.pattern) for r in url_filter.judge(pages).collect()}
    assert got == {i: ("block", p) for i, p in enumerate(url_filter.PATTERN_RULES)} | {99: ("allow", None)}


def test_url_rules_many(spark):
    """A hundred thousand rules, broadcast and joined, against trying those that can match; repeated rows and a rule without a token."""
    draw = random.Random(3)
    patterns = [f"^site{i}^*^page{i % 100}^" for i in range(100_000)] + ["*~*", "^site7^", "^"]
    hosts = [(f"h{i}.example/a{i % 3}/", draw.choice(["block", "allow"])) for i in range(20_000)] + list(url_filter.HOST_RULES)
    urls = [f"http://www.h{draw.randrange(30_000)}.example/a{draw.randrange(4)}/x" for _ in range(150)] + [f"http://b.c/site{i}/x/page{draw.choice([i % 100, 7])}" for i in draw.sample(range(100_000), 150)]
    urls += ["http://b.c/site7/", "http://b.c/~", "~", None, "", "http://b.c/site7/", "http://s.example.net/en/x"]
    pages = spark.createDataFrame([(i % 300, u, "x") for i, u in enumerate(urls)], "page_id int, url string, pattern string").repartition(3)
    few = [p for p in patterns[:-1] if any(u and p.split("^")[1] in u for u in urls if "site" in p) or "site" not in p]
    want = url_filter.judge(pages, hosts, few).collect()
    assert {r.rule is None for r in want} == {True, False} and len({r.pattern for r in want}) > 50
    for got in (url_filter.judge(pages, hosts, patterns[:-1]), url_filter.judge(pages, hosts, patterns[:-1], most=0)):
        assert got.columns == ["page_id", "host", "path", "rule", "verdict", "pattern"]
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want), key=str)
    for r in want:
        tried = [p for p in few if re.search(url_filter.parse_rule(p).regex, (urls[r.page_id] or "").lower())]
        fits = [h for h in hosts if (r.host == h[0].partition("/")[0] or r.host.endswith("." + h[0].partition("/")[0])) and r.path.startswith("/" + h[0].partition("/")[2])]
        if r.page_id >= 7:  # an id of one url
            assert r.rule == max((h[0] for h in fits), key=len, default=None) and r.pattern == (None if fits else next(iter(tried), None))


def test_topk(spark, monkeypatch):
    draw = np.random.default_rng(1)
    vectors = [[float(x) for x in draw.normal(size=4)] for _ in range(220)] + [[1.0] * 4] * 8 + [None, [None] * 4, [float("nan")] * 4, [float("inf")] * 4]
    rows = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<float>").withColumn("rank", F.lit("x"))
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.search(rows, shards=3).collect())
    good = {i: np.floor(256 * np.array(v, np.float32).astype(float)).astype(int) for i, v in enumerate(vectors[:228])}
    want = []
    for q in range(0, 228, 50):
        ranked = sorted(((-int(good[q] @ v), i) for i, v in good.items() if i != q))[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(ranked)]
    assert got == sorted(want)
    assert topk.search(rows.limit(0)).count() == 0
    monkeypatch.setattr(topk, "BLOCK_BYTES", 64)  # several blocks of queries
    monkeypatch.setattr(topk, "FAN", 2)
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.search(rows, shards=11).collect()) == got
    odd = spark.createDataFrame([(50, [1.0, 2.0]), (50, [1.0, 3.0]), (None, [9.0]), (3, [1.0, 2.0, 5.0]), (3, [1.0]), (4, [])], "vec_id int, embedding array<double>")
    assert [(r.rank, r.vec_id, r.score) for r in topk.search(odd).orderBy("rank").collect()] == [(1, 3, 327680), (2, 3, 65536), (3, 4, 0)]


def components(texts):
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return {i: (len(s), r) for i, (s, r) in enumerate(zip(sets, root, strict=True))}


def test_topk_each_row(spark, monkeypatch, tmp_path):
    """The query asks every row, and every other row is a candidate, rows with the same id and equal rows among them."""
    from lithic.llm import queries

    draw = np.random.default_rng(2)
    rows = [(int(draw.integers(0, 60)) * 5, [float(x) for x in draw.integers(-2, 3, size=3)]) for _ in range(300)] + [(50, [1.0, 2.0, 2.0])] * 8
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    want = []
    for a, (q, v) in enumerate(rows):
        if q % 50 == 0:
            ranked = sorted((-65536 * int(np.dot(v, w)), i) for b, (i, w) in enumerate(rows) if a != b)[:5]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(ranked)]
    assert sorted(map(tuple, queries.op5_exact_topk(spark, str(tmp_path)).collect())) == sorted(want)
    monkeypatch.setattr(topk, "FAN", 2)
    monkeypatch.setattr(topk, "TILE", 7)
    assert sorted(map(tuple, queries.op5_exact_topk(spark, str(tmp_path)).collect())) == sorted(want)


def test_jaccard_join(docs):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join(docs).collect()}
    assert got == components(TEXTS)


def test_jaccard_join_blocks(spark, monkeypatch):
    draw = np.random.default_rng(3)
    base = [f"b{i}" for i in range(80)]
    texts = []
    for i in range(90):
        words = [w if draw.random() > 0.02 * (i % 4) else f"e{i}_{k}" for k, w in enumerate(base)]
        texts.append(" ".join(words[: 60 + i % 21]))
    monkeypatch.setattr(jaccard_join, "BLOCK", 16)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join(rows).collect()} == components(texts)
    assert jaccard_join.join(rows.limit(0)).count() == 0
    nulls = spark.createDataFrame([(None, BASE), (5, BASE), (5, BASE), (6, None)], "doc_id long, text string")
    assert sorted((str(r.doc_id), str(r.component_id)) for r in jaccard_join.join(nulls).collect()) == [("5", "5"), ("5", "5"), ("6", "6"), ("None", "None")]


def test_jaccard_join_first_slot(spark):
    """Ids that fall on the first slot of the bit map: 587600 and 876020 hash to 0 in 20 bits."""
    text = " ".join(f"w{i}" for i in range(60))
    rows = spark.createDataFrame([(587600, text), (876020, text + " more"), (5, "alone in the world here")], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard_join.join(rows).collect()} == {587600: 587600, 876020: 587600, 5: 5}


def test_jaccard_join_shared_ids(spark):
    other = " ".join(f"o{i}" for i in range(60))
    rows = spark.createDataFrame([(3, other), (5, BASE), (5, other), (9, BASE + " more"), (11, "all alone here")], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in jaccard_join.join(rows).collect()) == [(3, 3), (5, 3), (5, 3), (9, 3), (11, 11)]


def test_jaccard_join_near_copies_on_disk(spark):
    """Near copies of every text: what is written is less than the texts, and a group of small sets is one tile."""
    draw = np.random.default_rng(5)
    base = [[f"word{x}" for x in draw.integers(0, 4000, 400)] for _ in range(20)]
    texts = [" ".join([*words, f"copy{k}"]) for words in base for k in range(15)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    before = len(common._staged)
    assert {r.doc_id: r.component_id for r in jaccard_join.join(rows).collect()} == {i: i // 15 * 15 for i in range(300)}
    files = [f for path in common._staged[before:] if "signed" not in path for f in Path(path.removeprefix("file://")).rglob("*.parquet")]
    assert 0 < 2 * sum(f.stat().st_size for f in files) < sum(map(len, texts))
    members = spark.range(1500).select(F.col("id").alias("doc_id"), F.lit(100).cast("long").alias("n"), F.lit(0).cast("long").alias("component"))
    assert jaccard_join._tiles(members).count() == 1500


def test_pipeline_one_of_each(spark):
    other = " ".join(f"o{i}" for i in range(60))
    texts = [(5, BASE), (5, BASE), (5, other), (None, BASE + " more"), (None, "x y z"), (None, "x y z"), (7, BASE + " more"), (8, "w"), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)
    kept = corpus_pipeline.drop_near_copies(spark, docs, SF)
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(5, BASE), (5, other), (None, "x y z"), (8, "w"), (None, None)], key=str)


def test_piece_codec(docs):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=piece_model())
    got = {r.doc_id: r for r in piece_codec.encode(docs, piece_model()).collect()}
    for i, t in enumerate(TEXTS):
        ids = sp.encode(t or "", add_eos=True)
        assert got[i].ids == ids and got[i].n_tokens == len(ids) and got[i].decoded == sp.decode(ids)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


def test_piece_codec_texts(spark, docs, monkeypatch):
    import sentencepiece

    monkeypatch.setattr(piece_codec, "BLOCK", 2000)  # several blocks; workers started by now may keep the old value
    sp = sentencepiece.SentencePieceProcessor(model_file=piece_model())
    draw = np.random.default_rng(11)
    texts = [" ", "▁", "a ", "  a", "\n", "\n\n a", " \n ", "a\r\nb", "\ta ▁▁b", "\ufffdé", "x" * 500, "\u2581", "â\u2580", "a▁ b ▁", "word " * 30_000, None, "", "twice", "twice"]
    texts += ["".join(draw.choice(list("ab\n\t ▁é漢𝄞\x00.")) for _ in range(int(draw.integers(1, 40)))) for _ in range(400)]
    rows = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, ids string").repartition(3, "doc_id")
    got = piece_codec.encode(rows, piece_model()).collect()
    assert len(got) == len(texts)
    own = piece_codec.codec(piece_model())
    for r in got:
        ids = sp.encode(texts[r.doc_id] or "", add_eos=True)
        assert (r.ids, r.n_tokens, r.decoded) == (ids, len(ids), sp.decode(ids)), texts[r.doc_id]
        assert own.decode(r.ids) == r.decoded
    assert piece_codec.encode(docs.limit(0), piece_model()).count() == 0
    nulls = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b")], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.n_tokens) for r in piece_codec.encode(nulls, piece_model(), full=False).collect()) == [("1", 3), ("1", 3), ("None", 3)]


def test_sharding(docs):
    got = sharding.shard(docs).collect()
    assert sorted(r.doc_id for r in got) == list(range(len(TEXTS)))
    for r in got:
        text = (TEXTS[r.doc_id] or "").encode()
        assert r["size"] == len(text) + 16 and r.text_crc32 == zlib.crc32(text) and r.law == "key"
        b, j = -1, 0
        while j < 40:
            b, bits = j, int(hashlib.md5(f"{r.doc_id}#{j}".encode()).hexdigest()[:13], 16)
            j = int((b + 1) / ((bits + 1) / 2**52))
        assert r.shard == b and r.grown_shard == (40 if j == 40 else b)
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert sharding.shard(docs.limit(0)).count() == 0
    odd = sharding.shard(docs.sparkSession.createDataFrame([(None, "a"), (None, "a"), (1, "x"), (1, "x"), (1, None)], "doc_id long, text string").withColumn("slot", F.lit("clash"))).collect()
    for key in (None, 1):
        own = [r for r in odd if r.doc_id == key]
        assert len({r.shard for r in own}) == 1
    for s in {r.shard for r in odd}:
        assert sorted(r.slot for r in odd if r.shard == s) == list(range(sum(r.shard == s for r in odd)))


def test_mixing(spark, docs):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 37).cast("int")).alias("text"), F.when(F.col("id") % 3 == 0, "big").when(F.col("id") % 50 == 1, "a").otherwise(F.when(F.col("id") % 7 == 1, "z")).alias("source"))
    got = mixing.mix(rows).collect()
    taken, target = Counter(), {}
    for r in got:
        key = (r.source_size, round(r.target, 6))
        taken[key] += r.taken
        target[key] = r.target
        assert 0 <= r.taken <= 3 * r["size"]
    assert sum(target.values()) == pytest.approx(sum(r["size"] for r in got))
    assert all(abs(taken[k] - t) <= 0.03 * t + 40 for k, t in target.items()) and all(t <= 3 * k[0] + 1e-6 for k, t in target.items())
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(rows.repartition(5)).collect()), key=str)
    carried = mixing.mix(docs, carry=("text", "source")).collect()
    assert sorted(((r.doc_id, r.copies, r.text, r.source) for r in carried), key=str) == sorted(((r.doc_id, r.copies, TEXTS[r.doc_id], f"s{r.doc_id % 3}" if r.doc_id % 5 else None) for r in mixing.mix(docs).collect()), key=str)
    odd = spark.createDataFrame([(None, "a b c", "s"), (None, "a b c", "s"), (1, "d", ""), (1, "d", None)], "doc_id long, text string, source string")
    assert sorted((str(r.doc_id), r.source_size) for r in mixing.mix(odd).collect()) == [("1", 1), ("1", 1), ("None", 6), ("None", 6)]
    assert mixing.mix(docs).count() == len(TEXTS) and mixing.mix(docs.limit(0)).count() == 0


def test_line_dedup(spark):
    common, field = "this very line stands in many of the documents", "the user {} logged in from the main office at noon today"
    texts = [f"first own line here with enough words to count\n{common}", f"{common}\nsecond own text that nobody else has written down", None, "", f"{common}\n{common}", field.format("ann"), field.format("bob"), field.format("7"), "short line\n\n", "short line"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("key", F.lit("clash"))
    got = {r.doc_id: r for r in line_templates.report(rows).collect()}
    assert got[0].text == texts[0] and got[1].text == texts[1].split("\n")[1] and got[2].text is None and got[3].text == "" and got[4].text == ""
    assert got[5].text == texts[5] and got[6].text == "" and got[7].text == "" and got[8].text == texts[8] and got[9].text == "short line"
    assert got[4].dropped == [0, 1] and got[4].n_lines == 2
    assert line_templates.report(rows.limit(0)).count() == 0


def dedup_by_hand(texts):
    """Which lines of each document go, from the rules, comparing every line with every other."""
    mask = lambda w: "0" if re.search("[0-9]", w) else w
    lines = [(d, k, tuple(map(mask, WORD.findall(x)))) for d, t in enumerate(texts) if t is not None for k, x in enumerate(t.split("\n"))]
    lines = [x for x in lines if x[2]]
    long, short = [x for x in lines if len(x[2]) >= 8], [x for x in lines if len(x[2]) < 8]
    root = {x[2]: x[2] for x in long}
    for a in list(root):
        for b in list(root):
            if len(a) == len(b) and a[:2] == b[:2] and sum(p != q for p, q in zip(a[2:], b[2:], strict=True)) <= -(-(len(a) - 2) // 3):
                low, high = sorted((root[a], root[b]))
                root = {w: low if r == high else r for w, r in root.items()}
    keys = [(x[0], x[1], x[1], ("long", root[x[2]]), 2) for x in long]
    for d, k, w in short:
        keys += [(d, k, k, ("short", w), 8)] + [(d, k, k, ("masked", i, w[:i] + ("*",) + w[i + 1 :]), 8) for i in range(2, len(w)) if len(w) >= 5]
    for d in {x[0] for x in lines}:
        own = [x for x in lines if x[0] == d]
        for a in range(len(own)):
            for b in range(a, len(own)):
                part = [len(x[2]) for x in own[a : b + 1]]
                if max(part) < 8 <= sum(part) and (sum(part[1:]) < 8 or sum(part[:-1]) < 8):
                    keys.append((d, own[a][1], own[b][1], ("unit", tuple(x[2] for x in own[a : b + 1])), 2))
    gone = {d: set() for d in range(len(texts))}
    worded = {(d, k) for d, k, _ in lines}
    for key in {k[3] for k in keys}:
        held = sorted({k[0] for k in keys if k[3] == key})
        for d, a, b, _, need in (k for k in keys if k[3] == key):
            if len(held) >= need and d != held[0]:
                gone[d] |= {i for i in range(a, b + 1) if (d, i) in worded}
    return {d: sorted(x) for d, x in gone.items()}


def test_line_dedup_by_hand(spark):
    draw = random.Random(9)
    known = [" ".join(draw.choice("abcdefgh") * draw.randrange(1, 3) for _ in range(draw.choice([1, 2, 3, 4, 5, 6, 7, 8, 9, 12]))) for _ in range(40)]

    def line():
        words = draw.choice(known).split(" ")
        for _ in range(draw.choice([0, 0, 1, 2, 3])):
            words[draw.randrange(len(words))] = draw.choice(["x1", "y", "77", "zz"])
        return draw.choice(["", " ", "  "]) + " ".join(words) + draw.choice(["", "\t", "\r"])

    texts = ["\n".join(draw.choice(["", " ", line(), line(), line(), line()]) for _ in range(draw.randrange(1, 14))) for _ in range(60)] + [None, "", "\n\n"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in line_templates.report(rows).collect()}
    want = dedup_by_hand(texts)
    assert {d: r.dropped for d, r in got.items()} == want and sum(map(len, want.values())) > 40
    for d, r in got.items():
        assert r.text == (None if texts[d] is None else "\n".join(x for k, x in enumerate(texts[d].split("\n")) if k not in want[d]))
    odd = spark.createDataFrame([(None, known[9] * 3), (None, known[9] * 3), (1, "\n".join(known)), (1, "\n".join(known)), (2, "\n".join(known))], "doc_id long, text string")
    kept = [(r.doc_id, r.n_dropped) for r in line_templates.report(odd).collect()]
    assert sorted(kept, key=str)[-2:] == [(None, 0), (None, 0)] and all(n == 0 for d, n in kept if d == 1) and all(n > 0 for d, n in kept if d == 2)


def test_line_dedup_places(spark):
    line = "the user {} logged in from the {} office at noon and left {} again"
    texts = [line.format(a, b, c) for a, b, c in (("ann", "main", "late"), ("bob", "north", "late"), ("bob", "north", "soon"), ("eve", "east", "never"))]
    texts += ["the user ann went out of the small door to see what had come up"] + [f"Posted by {who} in News" for who in ("ann", "bob", "cid", "dan", "eve", "fay", "gus", "hal")] + ["Posted by ann on Monday"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_templates.report(rows).collect()}
    assert [i for i in sorted(got) if got[i]] == [0, 4, 5, 13]


def test_line_dedup_passages(spark):
    verse = [f"verse {'so sweet ' * (i % 3)}{'abcdefghij'[i]}" for i in range(10)]
    long = "one long line that belongs to the {} document and stays in it"
    texts = ["\n".join(["mine", *verse[:5], "", *verse[5:], "end here"]), "\n".join(["yours", *verse[:4], verse[4], " ", *verse[5:], long.format("second")]), "\n".join([verse[0], long.format("3rd and last"), verse[1]]), verse[9]]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_templates.report(rows).collect()}
    assert got[0] == texts[0] and got[2] == texts[2] and got[3] == texts[3]
    assert got[1] == f"yours\n \n{long.format('second')}"


def test_line_units():
    draw = np.random.default_rng(7)
    for _ in range(200):
        sizes = draw.integers(1, 8, int(draw.integers(1, 9)))
        text = "\n".join(" ".join("w" * int(k) for k in draw.integers(1, 9, n)) for n in sizes)
        found = line_templates._units(line_templates._parse(line_templates.pa.array([text])))
        covered = {i for a, b, _ in found for x, y in zip(a, b, strict=True) for i in range(x, y + 1)}
        assert covered == (set(range(len(sizes))) if sizes.sum() >= 8 else set())


def test_line_groups():
    draw = np.random.default_rng(5)
    lines, leaf = [], []
    for n in (8, 11, 20):
        for _ in range(12):
            base = draw.integers(0, 50, n)
            for _ in range(int(draw.choice([1, 3, 40]))):
                copy = base.copy()
                for k in draw.choice(np.arange(2, n), int(draw.integers(0, n // 2)), replace=False):
                    copy[k] = draw.integers(0, 50)
                lines.append(copy)
                leaf.append(n)
    root = list(range(len(lines)))
    for i in range(len(lines)):
        for j in range(i):
            if leaf[i] == leaf[j] and (lines[i][2:] != lines[j][2:]).sum() <= -(-(leaf[i] - 2) // 3):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    for line in lines:
        line[:2] = 1  # the leaf's leading words
    ends = np.concatenate([[0], np.cumsum([len(x) for x in lines])])
    assert line_templates.groups(np.array(leaf, np.uint64), np.concatenate(lines).astype(np.uint32), ends).tolist() == root
    assert len(set(root)) < len(root)


def test_pipeline(spark):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line dedup", "n-gram jaccard join", "source mixing", "sentencepiece"]
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() > 0


def test_pipeline_by_hand(spark, tmp_path):
    """run() against every stage by hand, each on what the stage before it leaves."""
    import duckdb
    import sentencepiece

    draw = random.Random(4)
    vocabulary = ["".join(draw.choices("abcdeinorst", k=draw.randrange(2, 9))) for _ in range(300)]
    sentence = lambda n: " ".join(draw.choices(vocabulary, k=n))
    shared = [sentence(14) for _ in range(4)]
    rows, labels = [], []
    for i in range(240):
        text = "\n".join([sentence(draw.randrange(9, 30)) for _ in range(draw.randrange(1, 4))] + draw.sample(shared, draw.choice([0, 0, 1])))
        toxic = int(i % 4 == 0)
        rows.append((i, text + (" you idiot" if toxic else ""), "en", [None, "a", "b", "c"][i % 7 % 4], len(text), "extra"))
        labels.append((i, 1, toxic))
    rows += [(240 + k, rows[4 * k + 1][1] + (" more" if k % 2 else ""), "en", "b", 1, "extra") for k in range(20)] + [(260, None, "en", "a", 0, "extra"), (261, "", "en", None, 0, "extra")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _score string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = sorted(tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    kept = {i: (t, s) for i, t, _, s, _, _ in rows if model.probability(toxicity.document_margins(toxicity.pa.array([t], toxicity.pa.string()), model))[0] < toxicity.THRESHOLD}
    assert {i for i, _, y in labels if y} == {i for i, *_ in rows if i not in kept}
    ids = sorted(kept)
    gone = dedup_by_hand([kept[i][0] for i in ids])
    texts = {i: t and "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[n]) for n, i in enumerate(ids) for t in [kept[i][0]]}
    assert any(gone.values())
    copies = components([texts[i] for i in ids])
    left = [i for n, i in enumerate(ids) if copies[n][1] == n]
    assert len(left) < len(ids)
    spark.createDataFrame([(i, texts[i], kept[i][1]) for i in left], "doc_id long, text string, source string").coalesce(1).write.parquet(f"{tmp_path}/left.parquet")
    mixed = duckdb.sql(mixing.oracle().replace("FROM documents", f"FROM '{tmp_path}/left.parquet/*.parquet'")).fetchall()
    sp = sentencepiece.SentencePieceProcessor(model_file=piece_model())
    want = []
    for row in mixed:
        pieces = sp.encode(texts[row[0]] or "", add_eos=True)
        digests = [hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, pieces)), sp.decode(pieces))]
        want += [(row[0], len(pieces), *digests)] * row[4]
    assert got == sorted(want) and len(got) > 50
