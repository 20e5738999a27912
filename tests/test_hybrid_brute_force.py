"""The two large plans against plain loops over documents."""

import hashlib
import math
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from citelake.plans import hybrid

WORDS = [f"{a}{b}" for a in ("ka", "lo", "mi", "tu", "re", "so") for b in ("ban", "dor", "fel", "gin", "hup", "jat")]


def hash_vector(said, dim=1024):
    said = said.lower()
    out = defaultdict(float)
    for token in [x for p in (r"\d+(?:\.\d+)+", r"[a-z0-9]+", "[一-鿿]") for x in re.findall(p, said)] or ["__empty__"]:
        h = hashlib.sha256(token.encode()).digest()
        out[int.from_bytes(h[:4], "big") % dim] += (1 - 2 * (h[4] & 1)) * (1 + min(len(token), 8) / 8)
    norm = math.sqrt(sum(v * v for v in out.values()))
    return {k: v / norm for k, v in out.items()} if norm else {}


def top(scores, k):
    """{ordinal: score} -> {ordinal: (rank, score)}, best first, ties by ordinal."""
    order = sorted(scores, key=lambda o: (-round(scores[o], 9), o))[:k]
    return {o: (i, round(scores[o], 9)) for i, o in enumerate(order, 1)}


def brute_search(docs, question, k):
    words = list(dict.fromkeys(re.findall(r"[a-z0-9]{2,}", question.lower())))
    excerpt = lambda t: re.sub(r"\s+", " ", t).strip()[:200]
    body = {o: f"{t} {excerpt(t)}  ".lower() for o, t in docs.items()}
    lexical = lambda o: sum((1 + min(len(w), 12) / 12) * math.log1p(body[o].count(w)) for w in words)

    def cover(t):
        said = re.findall(r"\w+", t.lower())
        best, seen = 0.0, {}
        before = -1
        for i, w in enumerate(said):
            if w in words:
                seen[w] = i
                if len(seen) == len(words) and min(seen.values()) > before:
                    before = min(seen.values())
                    inside = sum(x in words for x in said[before : i + 1])
                    best += 0.1 / (1 + (i - before) - (inside - 1))
        return best

    asked = hash_vector(question)
    cosine = {o: sum(v * asked.get(i, 0.0) for i, v in hash_vector(t).items()) for o, t in docs.items()}
    routes = {
        "dense": top(cosine, max(k, 48)),
        "keyword": top({o: s for o in docs if (s := lexical(o)) > 0}, 24),
        "sparse": top({o: s for o, t in docs.items() if (s := cover(t)) > 0}, max(k, 24)),
    }
    for route in ("keyword", "sparse"):
        hits = routes[route]
        if len(hits) > 1:
            best = max(lexical(o) for o in hits)
            good = {o for o in hits if lexical(o) >= max(0.3, 0.25 * best)}
            routes[route] = {o: x for o, x in hits.items() if (o in good if good else x[0] <= 3)}
    fused, first = defaultdict(float), {}
    for i, (route, hits) in enumerate(routes.items()):
        for o, (rank, score) in hits.items():
            fused[o] += 1 / (60 + rank)
            first.setdefault(o, (i, rank, route, score))
    order = sorted(fused, key=lambda o: (-round(fused[o], 12), first[o][:2]))[: max(3 * k, 80)]
    tokens = set(re.findall(r"[a-z0-9]+", question.lower()))
    overlap = lambda o: 100 * sum(t in f"[route={first[o][2]}]\n{docs[o]}".lower() for t in tokens) + first[o][3]
    order = sorted(order, key=lambda o: -overlap(o))
    bare = re.sub(r"\s+", "", question.lower())

    def final(place, o):
        route = first[o][2]
        exact = 6.0 if 1 <= len(bare) <= 32 and bare in re.sub(r"\s+", "", body[o]) else 0.0
        exact += {"keyword": 1.0, "sparse": 0.8 - 2.5, "dense": 0.0}[route] + 0.3 * sum(len(w) >= 3 and w in body[o] for w in words)
        return round(5 * lexical(o) + exact + 0.03 * first[o][3] - 1e-4 * place, 9)

    ranked = sorted(enumerate(order), key=lambda x: (-final(*x), x[0]))
    return [(o, first[o][2]) for _, o in ranked][:k]


@pytest.mark.parametrize("seed", [1, 2])
def test_hybrid_search_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    docs = {i: " ".join(rng.choice(WORDS) for _ in range(rng.randint(3, 60))) for i in range(70)}
    questions = [(q, " ".join(rng.sample(WORDS, rng.randint(1, 4)))) for q in range(6)] + [(6, docs[3])]
    rows = spark.createDataFrame([(str(i), t, i) for i, t in docs.items()], "doc_id string, chunk_text string, ordinal long")
    got = defaultdict(list)
    for r in sorted(hybrid.search(hybrid.plain_rows(rows), spark.createDataFrame(questions, "query_id long, question string"), 10).collect(), key=lambda r: (r.query_id, r["rank"])):
        got[r.query_id].append((r.ordinal, r.route))
    for q, asked in questions:
        assert got[q] == brute_search(docs, asked, 10), asked


def test_texts_are_read_for_all_routes_at_once_and_once_more_for_their_hits(spark):
    """Each reading of the rows makes their excerpts anew."""
    rng = random.Random(3)
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(said):
        made.add(1)
        return said[:200]

    docs = [(str(i), " ".join(rng.choice(WORDS) for _ in range(9)), i) for i in range(400)]
    rows = spark.createDataFrame(docs, "doc_id string, chunk_text string, ordinal long").withColumn("excerpt", counted("chunk_text"))
    routes = {"dense": 3, "keyword": 3, "sparse": 3, "listing": 3}
    asked = spark.createDataFrame([(1, "kaban lodor")], "query_id long, question string")
    assert hybrid.search(hybrid.plain_rows(rows), asked, 3, routes=routes).count() == 3
    assert made.value <= 2 * 400


def brute_chunks(said, least=260, most=520, overlap=80):
    """Pages of 120 lines, blocks, chapters run together up to 1,200 characters, sentences packed, short ends joined, for
    plain lines without clause numbers, contents or titles but the patterns' own."""
    lines = [x.strip() for x in said.split("\n") if x.strip()]
    blocks = [(f"b_{i // 120 + 1}_{i % 120 + 1}", i // 120 + 1, re.sub(r"\s+", " ", x)) for i, x in enumerate(lines)]
    out = []
    for block, page, body in blocks:
        sentences = [s.strip() for s in re.split(r"(?<=[。！？；;!?\n])", body) if s.strip()]
        pieces = [body] if len(body) <= most else []
        for s in sentences if not pieces or len(body) > most else []:
            if pieces and len(pieces[-1]) + len(s) <= most:
                pieces[-1] += s
            elif pieces:
                pieces.append(pieces[-1][-overlap:] + s)
            else:
                pieces.append(s)
        out += [(p, page) for p in pieces]
    chunks = []
    for body, page in out:
        if chunks and len(chunks[-1][0]) + 1 + len(body) <= most:
            chunks[-1] = (f"{chunks[-1][0]}\n{body}", chunks[-1][1], page)
        else:
            chunks.append((body, page, page))
    if len(chunks) > 1 and len(chunks[-1][0]) < least:
        tail = chunks.pop()
        chunks[-1] = (f"{chunks[-1][0]}\n{tail[0]}", chunks[-1][1], tail[2])
    return chunks


def test_ingest_equals_brute_force(spark):
    rng = random.Random(5)
    line = lambda: " ".join(rng.choice(WORDS) + str(rng.randrange(100, 999)) for _ in range(rng.randint(15, 70))) + rng.choice([".", "!", "? " + " ".join(rng.sample(WORDS, 9)) + "; end of it"])
    docs = [(i, "\n".join(line() for _ in range(rng.choice([1, 2, 5, 130])))) for i in range(8)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = hybrid.ingest(hybrid.document_pages(df)).where("source_type = 'text'").collect()
    for i, t in docs:
        got = sorted(((r.chunk_id, r.chunk_text, r.page_start, r.page_end) for r in rows if r.doc_id == str(i)), key=lambda x: int(x[0].rsplit("_", 1)[1]))
        want = brute_chunks(t)
        assert [x[1:] for x in got] == want
