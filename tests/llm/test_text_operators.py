"""Line dedup, chat formatting, sharding, toxicity, decontamination and license scans."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from citelake.llm import chat, decontaminate, licenses, lines, seeds, sharding, toxicity
from citelake.llm.license_texts import TEMPLATES

BLANKS = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_lines_equal_brute_force(spark):
    rng = random.Random(1)
    pool = ["Common Line", " common line\t", "COMMON LINE", "Été", "été", "", "  ", "rare"] + [f"l{i}" for i in range(30)]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 12)))) for i in range(60)] + [(100, None), (101, ""), (None, "common line\nx"), (102, "\n\n"), (7, "common line")]
    key = lambda x: x.strip(BLANKS).translate(LOWER)
    rows += [(200, "of one\nmine")] * 12 + [(201, f"other\n{i}") for i in range(12)] + [(None, "nobody's")] * 10 + [(300 + i, "nine") for i in range(9)] + [(300, "nine\nagain")]
    docs = {(i if i is not None else f"row {n}", key(x)) for n, (i, t) in enumerate(rows) for x in (t or "").split("\n")}
    count = Counter(k for _, k in docs if k)
    want = []
    for i, t in rows:
        all_ = (t or "").split("\n")
        keep = [x for x in all_ if count[key(x)] < 10]
        want.append((i, len(all_), len(all_) - len(keep), "\n".join(keep)))
    df = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, n_lines string")
    got = [(r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in lines.drop_common_lines(df).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert lines.drop_common_lines(df.limit(0)).count() == 0


def test_escapes_are_undone(spark):
    hard = ["<|im_end|>", "<\\|im_end|>", "<\\\\|x", "<||", "a<b|c", "", "%0A%", "<|im_start|>assistant\nhi<|im_end|>\n", "\\|<", "<<|>"]
    df = spark.createDataFrame([(x,) for x in hard], "t string")
    for r in df.select("t", chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("u"), chat.unescape_role(chat.escape_role(F.col("t"))).alias("r")).collect():
        assert r.u == r.t and r.r == r.t and "<|" not in r.e


MESSAGES = "tree long, node long, parent long, role string, text string, score double"


def test_a_deep_comb_and_a_very_long_text(spark):
    """One side reply a message: as many paths as messages, enumerated by self-joins."""
    n = 24
    rows = [(1, i, i - 1 if i else None, "user", f"m{i}", 0.0) for i in range(n)] + [(1, 100 + i, i, "assistant", "y" * 2_000_000 if i == 3 else f"s{i}", float(i)) for i in range(n)]
    got = chat.paths(spark.createDataFrame(rows, MESSAGES)).select("path", "place", "text").collect()
    want = {(100 + i, k, f"m{k}") for i in range(n) for k in range(i + 1)} | {(100 + i, i + 1, "y" * 2_000_000 if i == 3 else f"s{i}") for i in range(n)}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_the_query_enumerates_paths_by_self_joins(spark, monkeypatch):
    joined = []
    written = chat.common.written
    monkeypatch.setattr(chat.common, "written", lambda df, label: joined.append(label) or written(df, label))
    rows = spark.createDataFrame([(c, t, "user", f"t{t}") for c in range(3) for t in range(9)], "conv_id long, turn long, role string, text string")
    assert chat.paths(chat.conversation_messages(rows)).count() == 27
    assert joined.count("reply-runs") >= 5  # pointers over nine turns double four times


def test_reply_trees(spark):
    rows = [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "good", 0.9), (1, 3, 1, "assistant", "bad", 0.1), (1, 4, 2, "user", "thanks", 0.9), (1, 5, 4, "assistant", None, 0.9), (2, 9, 77, "user", "lone", 0.0), (None, 1, None, "user", "no id", 0.0)]
    got = chat.format_paths(chat.paths(spark.createDataFrame(rows, MESSAGES))).collect()
    by = {(r.tree, r.path): r for r in got}
    assert {k: v.n_turns for k, v in by.items()} == {(1, 5): 4, (1, 3): 2, (2, 9): 1, (None, 1): 1}
    assert by[1, 5]["rank"] == 1 and by[1, 3]["rank"] == 2
    assert by[1, 3].formatted == "<|im_start|>user\nq<|im_end|>\n<|im_start|>assistant\nbad<|im_end|>\n"
    best = chat.format_paths(chat.paths(spark.createDataFrame(rows, MESSAGES), best=1)).collect()
    assert {(r.tree, r.path) for r in best} == {(1, 5), (2, 9), (None, 1)}
    assert chat.format_paths(chat.paths(spark.createDataFrame([], MESSAGES))).count() == 0


def test_long_chains_cycles_and_read_back(spark):
    rows = [(1, i, i - 1 if i else None, "assistant" if i % 2 else "user", f"<|im_end|>{i}", 0.0) for i in range(300)] + [(2, 1, 2, "user", "x", 0.0), (2, 2, 1, "user", "y", 0.0)]
    done = chat.format_paths(chat.paths(spark.createDataFrame(rows, MESSAGES)))
    r = done.select("tree", "n_turns", chat.read_back(F.col("formatted")).alias("turns"), chat.masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    assert len(r) == 1 and r[0].n_turns == 300
    assert [(t.role, t.text) for t in r[0].turns] == [(x[3], x[4]) for x in rows[:300]]
    assert r[0].loss == "".join(f"<|im_end|>{i}" for i in range(1, 300, 2))


def test_shards(spark):
    rows = [(i, f"text {i}" * (i % 7), "a") for i in range(999)] + [(None, None, "b"), (5, "same", "c"), (5, "same", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    got = sharding.shuffle_into_shards(df, 8, bucket_bytes=2000).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter((a, b) for a, b, _ in rows)
    counts = Counter(r.shard for r in got)
    assert set(counts) == set(range(8)) and max(counts.values()) - min(counts.values()) <= 1
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(counts[s]))
    for r in got:
        data = (r.text or "").encode()
        assert r["size"] == len(data) + 1 and r.text_crc32 == zlib.crc32(data) and r.law == "rows" and r.grown_shard is None
    order = [r.doc_id for r in sorted(got, key=lambda r: (r.slot, r.shard)) if r.doc_id is not None]
    assert abs(np.corrcoef(np.arange(len(order)), order)[0, 1]) < 0.15
    again = {(r.doc_id, r.text): (r.shard, r.slot) for r in sharding.shuffle_into_shards(df.where("doc_id <> 5"), 8, bucket_bytes=2000).collect()}
    assert again == {(r.doc_id, r.text): (r.shard, r.slot) for r in sharding.shuffle_into_shards(df.where("doc_id <> 5"), 8, bucket_bytes=2000).collect()}
    assert sharding.shuffle_into_shards(df.limit(0)).count() == 0


def test_order_follows_from_rows_seed_and_buckets(spark):
    rows = [(i, f"text {i % 40}") for i in range(400)]
    made = [sharding.shuffle_into_shards(spark.createDataFrame(r, "doc_id long, text string").repartition(n), 8, bucket_bytes=4000).collect() for r, n in ((rows, 1), (rows[::-1], 7))]
    one, two = ({r.doc_id: (r.shard, r.slot) for r in x} for x in made)
    assert one == two
    # brute force: a bucket's rows hold neighbouring places, and buckets follow each other
    other = {r.doc_id: (r.shard, r.slot) for r in sharding.shuffle_into_shards(spark.createDataFrame(rows, "doc_id long, text string"), 8, seed=18, bucket_bytes=4000).collect()}
    assert other != one and sorted(s * 8 + h for h, s in other.values()) == list(range(400)) == sorted(s * 8 + h for h, s in one.values())
    copies = {}
    for i, t in rows:
        copies.setdefault(t, []).append(one[i][0])
    assert all(len(set(x)) > 3 for x in copies.values())  # copies of a text are spread over the shards


def test_shards_are_written(spark, tmp_path):
    df = spark.createDataFrame([(i, f"t{i}") for i in range(50)], "doc_id long, text string")
    sharding.write_shards(sharding.shuffle_into_shards(df, 4), str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == 50 and back.select("shard").distinct().count() == 4


def toxic_corpus(n=600, seed=4):
    rng = random.Random(seed)
    bad, group = ["scum", "trash"], ["gnome", "troll"]
    rows, labels = [], []
    for i in range(n):
        words = [f"w{rng.randrange(300)}" for _ in range(rng.randint(5, 60))]
        toxic = rng.random() < 0.25
        if toxic:
            words += [rng.choice(bad), rng.choice(group)]
        elif rng.random() < 0.5:
            words += [rng.choice(bad if rng.random() < 0.5 else group)]  # either alone is fine
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_pairs_are_learnt_and_held_out_rows_are_never_used(spark):
    rows, labels = toxic_corpus()
    docs = spark.createDataFrame(rows + [(9000, None), (9001, ""), (None, "x")], "doc_id long, text string")
    known = spark.createDataFrame(labels + [(3, None)], "doc_id long, toxic int")
    machine = toxicity.train(docs, known)
    got = {r.doc_id: r.score for r in toxicity.score(docs, machine).collect()}
    assert all(0 <= s <= 1 for s in got.values()) and got[9000] == got[9001]
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    right = sum((got[i] >= 0.3) == bool(dict(labels)[i]) for i in held)
    assert right / len(held) > 0.9
    spoiled = spark.createDataFrame([(i, 1 - y if i in set(held) else y) for i, y in labels], "doc_id long, toxic int")
    other = toxicity.train(docs, spoiled)
    assert (other.weights == machine.weights).all() and other.bias == machine.bias


def test_scores_equal_the_formula(spark):
    """sigmoid(b + sum w_i + sum over pairs <v_i, v_j>) of a text's distinct terms, pair by pair."""
    rows, labels = toxic_corpus(300)
    docs = spark.createDataFrame(rows + [(900, "scum GNOME scum"), (901, None)], "doc_id long, text string")
    m = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    place = {int(s): i for i, s in enumerate(m.slots)}
    assert len(place) > 2
    for r in toxicity.score(docs, m).collect():
        own = sorted({place[s] for t in seeds.TERM.findall((r.text or "").lower()) if (s := zlib.crc32(t.encode()) % toxicity.SLOTS) in place})
        z = m.bias + sum(m.weights[i] for i in own) + sum(float(m.factors[i] @ m.factors[j]) for k, i in enumerate(own) for j in own[k + 1 :])
        assert r.score == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-9)


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score(docs, toxicity.train(docs, none)).first().score == pytest.approx(0.5)
    one_class = spark.createDataFrame([(0, 0), (1, 0)], "doc_id long, toxic int")
    assert toxicity.score(docs, toxicity.train(docs, one_class)).first().score < 0.5
    assert toxicity.score(docs.limit(0), toxicity.train(docs, none)).count() == 0


def align(a, b):
    """Smith-Waterman by its recurrence: best score only."""
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b, 1):
            new.append(max(0, row[j - 1] + (2 if x == y else -1), row[j] - 1, new[-1] - 1))
        best, row = max(best, *new), new
    return best


def test_alignment_scores():
    rng = np.random.default_rng(2)
    for _ in range(200):
        a, b = rng.integers(1, 5, rng.integers(1, 12)), rng.integers(1, 5, rng.integers(1, 20))
        assert decontaminate.smith_waterman(a, b)[0] == align(a.tolist(), b.tolist())


def test_leaks_are_found_in_all_forms(spark):
    rng = random.Random(6)
    items = [(i, " ".join(f"w{rng.randrange(500)}" for _ in range(rng.randint(12, 50)))) for i in range(30)]
    filler = lambda n: " ".join(f"w{rng.randrange(500)}" for _ in range(n))
    rows, want = [], set()
    for i, t in items:
        w = t.split()
        edited = [("zz" if k % 6 == 5 else x) for k, x in enumerate(w)]
        dropped = [x for k, x in enumerate(w) if k % 7 != 6]
        for k, form in enumerate((t, t.upper().replace(" ", ", "), " ".join(edited), " ".join(dropped))):
            rows.append((i * 10 + k, f"{filler(80)} {form} {filler(60)}"))
            want.add((i * 10 + k, i))
        rows.append((i * 10 + 8, f"{filler(50)} {' '.join(w[: len(w) // 2])} {filler(50)}"))  # half an item is no leak
    rows += [(1000, None), (1001, ""), (None, items[0][1])]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, hits string")
    bench = spark.createDataFrame([*items, (77, None), (78, "one two")], "item_id long, text string")
    hits = decontaminate.with_hits(docs, bench).select("doc_id", F.explode("hits").alias("h")).select("doc_id", "h.*").collect()
    assert {(r.doc_id, r.item_id) for r in hits} == want | {(None, 0)}
    small = decontaminate.with_hits(docs, bench, block_words=100).select("doc_id", F.explode("hits").alias("h")).select("doc_id", "h.item_id").collect()
    assert {(r.doc_id, r.item_id) for r in small} == want | {(None, 0)}
    assert decontaminate.with_hits(docs, bench.limit(0)).where(F.size("hits") > 0).count() == 0
    assert decontaminate.with_hits(docs.limit(0), bench).count() == 0


def test_rarer_grams_become_seeds():
    index = seeds.SeedIndex([[f"w{i}" for i in range(40)]], 3)
    codes = index._codes(index.coded[0], 3).tolist()
    counts = {c: 10**6 for c in codes} | {codes[k]: 1 for k in range(1, 38, 2)}
    assert index.rare(counts, 30).tolist() == sorted(codes[k] for k in range(1, 38, 2))
    counts[codes[1]] = 0  # a gram that occurs nowhere is no seed and takes no other's place
    assert codes[1] not in index.rare(counts, 30) and {codes[0], codes[2]} & set(index.rare(counts, 30).tolist())


def worn(rng, words, edits):
    """words after that many changes, losses and insertions."""
    out = list(words)
    for _ in range(edits):
        at, kind = rng.randrange(len(out)), rng.randrange(3)
        out[at : at + 1] = {0: [f"x{rng.random()}"], 1: [], 2: [f"y{rng.random()}", out[at]]}[kind]
    return out


def test_every_edited_copy_keeps_a_seed(spark):
    """Every document against every item: whatever the copy's edits, up to a fifth of the item's words, it is found, and
    what is found aligns with 80 % of the item."""
    rng = random.Random(12)
    items = [(n * 10 + k, [f"v{rng.randrange(3000)}" for _ in range(n)]) for n in range(1, 45) for k in range(2)]
    rows, planted = [], set()
    for i, w in items:
        for k in range(4):
            form = worn(rng, w, rng.randint(0, len(w) // 5))
            rows.append((len(rows), " ".join([f"f{rng.random()}" for _ in range(15)] + form + [f"g{rng.random()}" for _ in range(9)])))
            planted.add((len(rows) - 1, i))
    rows.append((len(rows), "a b c ZZ e f g YY i j"))
    items.append((9000, "a b c d e f g h i j".split()))
    planted.add((len(rows) - 1, 9000))
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.with_hits(docs, bench).select("doc_id", F.explode("hits").alias("h")).select("doc_id", "h.*").collect()}
    vocabulary = {x: k for k, x in enumerate(sorted({x for _, w in items for x in w} | {x for _, t in rows for x in seeds.terms(t)}), 1)}
    coded = {i: np.array([vocabulary[x] for x in w]) for i, w in items}
    want = set()
    for d, t in rows:
        part = np.array([vocabulary[x] for x in seeds.terms(t)])
        for i, w in coded.items():
            if len(set(w.tolist()) & set(part.tolist())) and decontaminate.smith_waterman(w, part)[1] >= 0.8 * len(w) - 1e-9:
                want.add((d, i))
    assert got <= want and planted & want <= got
    assert len(got & want) >= 0.99 * len(want)


def test_long_items_align_in_little_memory():
    rng = np.random.default_rng(4)
    item = rng.integers(1, 1000, 6000)
    part = np.concatenate([rng.integers(1, 1000, 300), np.delete(item, np.arange(0, 6000, 50)), rng.integers(1, 1000, 300)])
    score, matches, first, last = decontaminate.smith_waterman(item, part)
    assert matches >= 5880 and first >= 295 and last < len(part) - 295


def test_internal_names_do_not_clash(spark):
    names = ["row", "id", "t1", "t2", "lines", "gone", "h", "at", "d", "u1", "bucket", "place", "hash", "first", "count", "hits_0", "hits_0_", "_t1", "_at", "_hits0", "m", "n"]
    rows = [(i, "same line\nown %d" % i, *range(len(names))) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` int" for n in names))
    bench = spark.createDataFrame([(1, "same line own 3")], "item_id long, text string")
    for out in (lines.drop_common_lines(df), sharding.shuffle_into_shards(df), decontaminate.with_hits(df, bench), licenses.with_licenses(df)):
        got = out.collect()
        assert len(got) == 12 and set(names) <= set(out.columns) and all(r[n] == k for r in got for k, n in enumerate(names))


def test_very_long_texts(spark):
    rng = random.Random(3)
    words = [f"w{rng.randrange(5000)}" for _ in range(300_000)]
    text = "\n".join(" ".join(words[k : k + 10]) for k in range(0, len(words), 10))
    df = spark.createDataFrame([(1, text), (2, text + " end"), (3, " ".join(words[:100]) + " scum")], "doc_id long, text string")
    got = {r.doc_id: r for r in lines.drop_common_lines(df, min_docs=2).collect()}
    assert got[1].kept_text == "" and got[1].n_dropped + 1 == 30_000 or got[1].n_dropped == 29_999
    assert got[2].kept_text.endswith(" end") and got[3].n_dropped == 0
    item = " ".join(words[1000:1040])
    hits = decontaminate.with_hits(df, spark.createDataFrame([(5, item)], "item_id long, text string")).select("doc_id", F.size("hits").alias("n")).collect()
    assert {r.doc_id: r.n for r in hits} == {1: 1, 2: 1, 3: 0}
    assert sharding.shuffle_into_shards(df, bucket_bytes=1 << 20).count() == 3


def test_labels_that_differ_and_repeated_ids_give_one_model(spark):
    rows, labels = toxic_corpus(200)
    twice = [(i, 1 - y) for i, y in labels[:10]]
    one = toxicity.train(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels + twice, "doc_id long, toxic int"))
    two = toxicity.train(spark.createDataFrame(rows[::-1], "doc_id long, text string").repartition(3), spark.createDataFrame((twice + labels)[::-1], "doc_id long, toxic int"))
    assert one.bias == two.bias and (one.slots == two.slots).all() and (one.weights == two.weights).all()


def test_patience_matches_grow_and_cover():
    m = licenses.patience([1, 2, 3, 4, 5, 6], [9, 1, 2, 0, 4, 5, 6, 9])
    assert [i for i, _ in m] == [0, 1, 3, 4, 5] and all(x[1] < y[1] for x, y in zip(m, m[1:], strict=False))
    assert licenses.longest_increasing([3, 1, 2, 5, 4]) in ([1, 2, 3], [1, 2, 4])


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b, 1):
            new.append(row[j - 1] + 1 if x == y else max(row[j], new[-1]))
        row = new
    return row[-1]


def test_worn_licenses_equal_brute_force(spark):
    """Every template with up to a fifth of its words edited: found with the template's own words, and never covered more
    than the longest common subsequence allows."""
    rng = random.Random(8)
    rows, planted = [], set()
    for name, t in TEMPLATES.items():
        w = seeds.terms(t)
        for k in range(4):
            form = worn(rng, w, (len(w) // 5) * k // 3)
            rows.append((len(rows), f"some code here {' '.join(form)} more code there"))
            if lcs(w, form) >= 0.8 * len(w) and licenses.deciding(name, w) <= set(form):
                planted.add((len(rows) - 1, name))
    rows.append((len(rows), "Released under an MIT License."))
    planted.add((len(rows) - 1, "MIT/notice"))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.license_id): r.matched_words for r in licenses.with_licenses(df).select("doc_id", F.explode("licenses").alias("l")).select("doc_id", "l.*").collect()}
    texts = dict(rows)
    for (d, name), n in got.items():
        assert 0.8 * len(seeds.terms(TEMPLATES[name])) <= n <= lcs(seeds.terms(TEMPLATES[name]), seeds.terms(texts[d]))
    assert len(planted & set(got)) >= 0.9 * len(planted) and (len(rows) - 1, "MIT/notice") in got
    clean = {(d, name) for d, name in got if (d, name) not in planted and lcs(seeds.terms(TEMPLATES[name]), seeds.terms(texts[d])) < 0.8 * len(seeds.terms(TEMPLATES[name]))}
    assert not clean


NEIGHBOURS = {
    "Released under the BSD License.": set(), "Released under the Apache License.": set(), "Released under the ISC License.": set(), "Released under the MIT No Attribution License.": set(), "Released under the License.": set(),
    "Licensed under CC BY 4.0.": set(), "Licensed under CC BY-SA 4.0.": set(), "Licensed under CC BY-NC-SA 4.0.": set(), "Licensed under CC BY-NC-ND 4.0.": set(), "Licensed under CC BY-NC 3.0.": set(), "Licensed under CC BY-NC 4.0.": {"CC-BY-NC-4.0/notice"},
    "This work is licensed under the GNU Affero General Public License, version 3.": set(), "This work is licensed under the GNU Lesser General Public License, version 3.": set(), "This work is licensed under the GNU General Public License, version 2.": set(),
    "This work is licensed under the GNU General Public License, version 3.": {"GPL-3.0/notice"}, "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": set(), "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.": set(),
    "This work is licensed under a Creative Commons Attribution 3.0 International License.": set(), "This work is licensed under a Creative Commons Attribution 4.0 International License.": {"CC-BY-4.0/notice"}, "Licensed under the Apache License, Version 1.1.": set(), "Licensed under the Apache License, Version 2.0.": {"Apache-2.0/notice"},
    "Released under the MIT License. Licensed under CC BY-NC 4.0.": {"MIT/notice", "CC-BY-NC-4.0/notice"},
}


def test_neighbours_of_licenses_are_told_apart(spark):
    """Every template gives itself alone, and other licenses' notices give none."""
    cases = dict(NEIGHBOURS)
    for name, t in TEMPLATES.items():
        cases[f"before\n{t}\nafter"] = {name}
    gpl, lgpl = TEMPLATES["GPL-3.0-or-later/header"], TEMPLATES["LGPL-2.1-or-later/header"]
    cases |= {gpl.replace("version 3", "version 2"): set(), lgpl.replace("2.1", "3"): set(), TEMPLATES["AGPL-3.0-or-later/header"].replace("Affero", "Lesser"): set(), TEMPLATES["MPL-2.0/header"].replace("2.0", "1.1"): set(), TEMPLATES["EPL-2.0/header"].replace("2.0", "1.0"): set()}
    cases["long " * 200_000 + gpl + " long" * 200_000 + "\n" + TEMPLATES["BSD-3-Clause/text"]] = {"GPL-3.0-or-later/header", "BSD-3-Clause/text"}
    rows = list(enumerate(cases))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {i: set() for i, _ in rows}
    for r in licenses.with_licenses(df).select("doc_id", F.explode("licenses").alias("l")).collect():
        got[r.doc_id].add(r.l.license_id)
    assert {t[:90]: got[i] for i, t in rows} == {t[:90]: want for t, want in cases.items()}


def test_licenses_are_found(spark):
    mit = TEMPLATES["MIT/text"]
    worn = " ".join(w for k, w in enumerate(mit.split()) if k % 11)
    rows = [(1, f"code\n{mit}\nmore"), (2, f"/* {worn.upper()} */"), (3, "nothing of the kind"), (4, "Released under the MIT License."), (5, None), (6, ""), (7, " ".join(mit.split()[:40]))]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, licenses int")
    got = {(r.doc_id, r.license_id): r.coverage for r in licenses.with_licenses(df).select("doc_id", F.explode("licenses").alias("l")).select("doc_id", "l.*").collect()}
    assert set(got) == {(1, "MIT/text"), (2, "MIT/text"), (4, "MIT/notice")} and got[1, "MIT/text"] == 1.0 and got[2, "MIT/text"] > 0.85
    assert licenses.with_licenses(df.limit(0)).count() == 0
