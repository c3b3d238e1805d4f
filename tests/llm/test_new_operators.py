"""Importance resampling, fill-in-the-middle and chat formatting against brute force and odd rows."""

import math
import random
import re
from collections import Counter
from hashlib import sha256
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F
from test_operators import make, no_docs, odd, sentence  # noqa: F401

from strayline.llm import chat_format, fill_middle, resample

# --- importance resampling -------------------------------------------------------------------


def words_of(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def buckets_of(text, longest, buckets):
    words = words_of(text)
    runs = [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]
    return [crc32(r.encode()) % buckets for r in runs]


def slow_importance(docs, target, longest=1, buckets=10_000, percent=10, fewest=20, seed=2024):
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(buckets_of(text, longest, buckets))
    for text in target:
        t.update(buckets_of(text, longest, buckets))
    S, T = sum(s.values()), sum(t.values())

    def gain(b):
        return math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets))))

    rows = []
    for doc_id, text in docs:
        found = buckets_of(text, longest, buckets)
        h = int(sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, found))
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([doc_id, len(words_of(text)), len(found), weight, score, None])
    long = sorted((r for r in rows if r[1] >= fewest), key=lambda r: (-r[4], r[0] is None, r[0]))
    for rank, row in enumerate(long[: len(long) * percent // 100], 1):
        row[5] = rank
    return sorted(map(str, rows))


def ranked(df):
    return sorted(str([r["doc_id"], r["n_words"], r["n_features"], r["weight"], r["score"], r["rank"]]) for r in df.collect())


@pytest.mark.parametrize("how", [{}, {"longest": 3, "buckets": 97, "percent": 55, "fewest_words": 4, "seed": 5}])
def test_importance(spark, make, how):  # noqa: F811
    rng = random.Random(3)
    texts = {i: " ".join(sentence(rng, rng.randint(1, 9)) for _ in range(rng.randint(0, 9))) + " É99中 É99" * (i % 3) for i in range(150)}
    target = [(i, " ".join(sentence(rng) for _ in range(5)) + " " + texts[i]) for i in range(20)]
    found = resample.importance(make(texts), spark.createDataFrame(target, "item_id long, text string"), **how)
    named = {"fewest_words": "fewest"}
    slow = slow_importance(list(texts.items()), [t for _, t in target], **{named.get(k, k): v for k, v in how.items()})
    assert ranked(found) == slow


def test_importance_of_odd_rows(spark, odd, no_docs, make):  # noqa: F811
    target = spark.createDataFrame([(0, None), (1, ""), (2, "two words here")], "item_id long, text string")
    how = {"percent": 60, "fewest_words": 1}
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    slow = slow_importance(rows, [None, "", "two words here"], percent=60, fewest=1)
    assert ranked(resample.importance(odd, target, **how)) == slow
    assert resample.importance(no_docs, target).collect() == []
    assert resample.resample(no_docs, target).collect() == []
    assert resample.importance(odd, target.limit(0), **how).count() == odd.count()
    drawn = resample.resample(odd, target, percent=100, fewest_words=1)
    assert drawn.columns == odd.columns
    assert sorted(map(str, drawn.collect())) == sorted(str(r) for r in odd.collect() if words_of(r["text"]))
    copies = make([(1, "the same text " * 10, "s")] * 40)  # as many ranks as rows, though all are equal
    ranks = [r["rank"] for r in resample.importance(copies, target, percent=50).collect()]
    assert sorted(r for r in ranks if r) == list(range(1, 21))


def test_ranks_do_not_depend_on_layout(spark, make):  # noqa: F811
    rng = random.Random(4)
    docs = make({i: " ".join(sentence(rng) for _ in range(4)) for i in range(200)})
    target = spark.createDataFrame([(0, "abc abd abe")], "item_id long, text string")
    found = [ranked(resample.importance(docs.repartition(n), target, percent=50)) for n in (1, 7)]
    assert found[0] == found[1]


def test_interned_grams_keep_apart_what_collides():
    rng = random.Random(5)
    texts = [" ".join(rng.choices(["a", "bb", "abcdefgh" * 5, "ö", "x1"], k=200)).encode() for _ in range(3)] + [b"", b"--"]
    grams = resample.grams_of(texts, 2)
    runs = [grams.joined[a:b] for a, b in zip(grams.start, grams.stop)]
    hashed = [xxhash.xxh64_intdigest(r) for r in runs]
    assert resample.xxhash64(grams.joined, grams.start, grams.stop).tolist() == hashed
    alike = lambda joined, start, stop: np.full(len(start), 7, dtype=np.uint64)
    for key in (resample.xxhash64, alike):
        table = resample.intern(grams, 1000, key)
        by_slot = {}
        for run, slot in zip(runs, table.slot_of.tolist()):
            assert by_slot.setdefault(slot, run) == run
        counts = Counter(runs)
        assert len(by_slot) == len(counts)
        for slot, run in by_slot.items():
            assert table.count[slot] == counts[run] and table.bucket[slot] == crc32(run) % 1000


# --- fill in the middle ----------------------------------------------------------------------


def slow_fill(doc_id, text, seed=1, rate=90, suffix_first=20):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return doc_id, len(units), "plain", None, None, text
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < suffix_first:
        return doc_id, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("frame_bytes", [1, 5, 64, 1 << 16])
def test_fill_in_middle(make, frame_bytes):  # noqa: F811
    rng = random.Random(6)
    texts = {i: "".join(rng.choices("abcXYZ <>PSM\né中\U0001f600 ", k=rng.randint(0, 120))) for i in range(150)}
    texts |= {200: "has <P> in it", 201: "<S", 202: "a" * 300, 203: "<M>", 204: "é" * 50, 205: ">" * 9}
    made = fill_middle.fill_in_middle(fill_middle.store_frames(make(texts), frame_bytes))
    rows = {r["doc_id"]: r for r in fill_middle.output_text(made).collect()}
    digests = {r["doc_id"]: r for r in fill_middle.with_digests(made).collect()}
    assert len({rows[i]["form"] for i in rows}) == 3
    for i, text in texts.items():
        r = rows[i]
        assert (i, r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == slow_fill(i, text)
        assert digests[i]["output_sha256"] == sha256(r["output"].encode()).hexdigest()
        assert digests[i]["restored_sha256"] == sha256(text.encode()).hexdigest()


def test_frames_are_independent_and_counted(make):  # noqa: F811
    text = "word, " * 400 + "x" * 900 + "ö" * 40
    row = fill_middle.store_frames(make({1: text}), 100).first()
    parts = [zstandard.ZstdDecompressor().decompress(f).decode() for f in row["frames"]]
    assert "".join(parts) == text and len(parts) > 30
    assert list(row["chars"]) == [len("".join(parts[:i])) for i in range(len(parts) + 1)]
    units = lambda t: len(re.findall(r"[A-Za-z]+|[^A-Za-z]", t))
    assert row["units"][-1] == units(text)
    framed = fill_middle.Framed(row["frames"], row["units"], row["chars"])
    found = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    for unit in (0, 1, 17, len(found) - 41, len(found) - 40, len(found)):
        assert framed.cut_at(unit)[2] == len("".join(found[:unit]))


def test_fill_in_middle_of_odd_rows(odd, no_docs):  # noqa: F811
    made = fill_middle.with_digests(fill_middle.fill_in_middle(fill_middle.store_frames(odd, 1000)))
    key = lambda r: str(tuple(r))
    expected = []
    for r in odd.collect():
        *head, output = slow_fill(r["doc_id"], r["text"])
        expected.append((*head, sha256(output.encode()).hexdigest(), sha256((r["text"] or "").encode()).hexdigest()))
    assert sorted(map(key, made.collect())) == sorted(map(key, expected))
    assert fill_middle.fill_in_middle(fill_middle.store_frames(no_docs)).collect() == []


# --- chat formatting -------------------------------------------------------------------------

TURNS = "words string, conv_id long, turn long, role string, text string, part int, loss string"


def turns_frame(spark, rows):
    return spark.createDataFrame([("x", *r, 1, "y") for r in rows], TURNS)


def slow_escape(text):
    text = text.replace("\\", "\\\\")
    for c in ("<s>", "</s>", "[INST]", "[/INST]"):
        text = text.replace(c, f"{c[0]}\\{c[1:]}")
    return text


def slow_format(rows):
    """``{conv_id: (formatted, turns, learned texts)}``."""
    first = lambda x: (x is not None, x)
    by = {}
    for row in sorted(rows, key=lambda r: [first(x) for x in r]):
        conv_id, _, role, text = row
        by.setdefault(conv_id, []).append((role or "", text or "", role == "assistant"))
    return {
        c: (
            "".join(f"<s>{slow_escape(r)}[INST]{slow_escape(t)}[/INST]</s>" for r, t, _ in turns),
            [(r, t) for r, t, _ in turns],
            [t for _, t, learned in turns if learned],
        )
        for c, turns in by.items()
    }


def slow_read(rows):
    digest = lambda pieces: sha256("".join(pieces).encode()).hexdigest()
    return sorted(
        str((c, len(turns), digest(f"{r}\n{t}\n" for r, t in turns), len("".join(learned)), digest(learned), len(text)))
        for c, (text, turns, learned) in slow_format(rows).items()
    )


def hard_rows():
    rng = random.Random(7)
    bits = ["<s>", "</s>", "[INST]", "[/INST]", "\\", "<", "[", "s>", "/INST]", "é", "中", "\U0001f600", "\n", "word ", "<\\s>"]
    rows = []
    for c in range(60):
        for t in range(rng.randint(1, 6)):
            rows.append((c, t, rng.choice(["user", "assistant", "system", "a[INST]b", "\\"]), "".join(rng.choices(bits, k=rng.randint(0, 30)))))
    rows += [(100, 0, "user", None), (100, 1, None, "no role"), (100, None, "assistant", "no turn"), (None, 0, "assistant", "no id"), (None, 1, "user", "")]
    rows += [(101, 0, "assistant", "twice")] * 2 + [(101, 0, "assistant", "tie"), (102, 0, "assistant", ""), (103, 5, "user", "z" * 30_000), (103, 6, "assistant", "</s>" * 5_000)]
    return rows


@pytest.mark.parametrize("hot_bytes", [1 << 22, 200])
def test_format_conversations(spark, hot_bytes, monkeypatch):
    monkeypatch.setattr(chat_format, "_STRETCH", 97)
    rows = hard_rows()
    random.Random(8).shuffle(rows)
    made = chat_format.format_conversations(turns_frame(spark, rows).repartition(5), hot_bytes=hot_bytes)
    assert sorted(map(str, map(tuple, chat_format.read_back(made).collect()))) == slow_read(rows)
    parts = sorted(made.collect(), key=lambda r: (str(r["conv_id"]), r["part"]))
    expected = slow_format(rows)
    texts, learned = {}, {}
    for r in parts:
        texts[r["conv_id"]] = texts.get(r["conv_id"], "") + r["formatted"]
        raw = r["formatted"].encode()
        learned.setdefault(r["conv_id"], []).extend(chat_format.unescape(raw[s["start"] : s["stop"]]).decode() for s in r["loss"])
    assert texts == {c: text for c, (text, _, _) in expected.items()}
    assert learned == {c: pieces for c, (_, _, pieces) in expected.items()}
    assert (len(parts) > len(texts)) == (hot_bytes == 200) == any(r["sliced"] for r in parts)


def test_one_conversation_is_dealt_out(spark):
    rng = random.Random(9)
    rows = [(1, t, rng.choice(["user", "assistant"]), sentence(rng)) for t in range(400)]
    made = chat_format.format_conversations(turns_frame(spark, rows), hot_bytes=500)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert made.select(F.shiftright("part", 33).alias("task")).distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [str(tuple(r)) for r in chat_format.read_back(made).collect()] == slow_read(rows)


def test_no_conversations(spark):
    made = chat_format.format_conversations(turns_frame(spark, []))
    assert made.collect() == [] and chat_format.read_back(made).collect() == []


def test_one_buffer_holds_all_texts():
    roles, texts = pa.array(["user", "assistant", "user"]), pa.array(["a<s>", None, "\\"])
    formatted, loss = chat_format.assemble(roles, texts, np.array([0, 2]))
    assert formatted.to_pylist() == ["<s>user[INST]a<\\s>[/INST]</s><s>assistant[INST][/INST]</s>", "<s>user[INST]\\\\[/INST]</s>"]
    assert loss.to_pylist() == [[{"start": 47, "stop": 47}], []]
    assert sum(b.size for b in formatted.buffers()[2:]) == sum(len(t) for t in formatted.to_pylist())


def test_similarities_of_line_pairs():
    """As sets of shingles give them: short lines, equal lines, repeats, lines with nothing in common."""
    import random

    from strayline.llm import line_dedup

    draw = random.Random(3)
    x = ["".join(draw.choices("abc dé中", k=draw.randint(1, 60))) for _ in range(300)]
    y = [a if i % 3 == 0 else a[: len(a) // 2] + "zz" + a[len(a) // 2 :] if i % 3 == 1 else draw.choice(x) for i, a in enumerate(x)]
    x, y = [*x, "a" * 500, "ab"], [*y, "a" * 7, "ab\x00"]
    for width in (1, 5, 10):
        found = line_dedup.similarities(x, y, width)
        for a, b, j in zip(x, y, found):
            s, t = ({z[i : i + width] for i in range(max(len(z) - width + 1, 1))} for z in (a, b))
            assert abs(j - len(s & t) / len(s | t)) < 1e-12
