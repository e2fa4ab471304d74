import base64
import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from facetlake.llm import decontaminate, langid, repeats, simhash, tokens, warc
from facetlake.llm.queries import QUERIES
from facetlake.llm.queries_free import tokenizer_file


def documents(spark, sf):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


# --- SimHash ---------------------------------------------------------------


def brute_print(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    ids = [d for d, _ in prints]
    values = np.array([p for _, p in prints], np.uint64)
    root = list(range(len(ids)))

    def top(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(values ^ values[i]) <= 2):
            root[top(int(j))] = top(i)
    least = {}
    for i, d in enumerate(ids):
        least[top(i)] = min(d, least.get(top(i), d))
    return {d: least[top(i)] for i, d in enumerate(ids)}


def test_simhash_query_matches_brute_force(spark, sf):
    prints = [(d, brute_print(t)) for d, t in documents(spark, sf)]
    parts = brute_components(prints)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op2_simhash"](spark, sf).collect()}
    assert got == {d: (f"{p:016x}", parts[d]) for d, p in prints}


def test_anchors_cover_every_near_pair():
    rng = np.random.default_rng(3)
    fps = rng.integers(0, 1 << 63, 300, dtype=np.uint64) * np.uint64(2)
    near = fps.copy()
    for _ in range(2):
        near ^= np.uint64(1) << rng.integers(0, 64, 300, dtype=np.uint64)
    row, anchor, home = simhash.anchors(fps, 2)
    homes = dict(zip(row[home].tolist(), anchor[home].tolist(), strict=True))
    assert len(homes) == 300
    row2, anchor2, _ = simhash.anchors(near, 2)
    reached = set(zip(row2.tolist(), anchor2.tolist(), strict=True))
    assert all((i, homes[i]) in reached for i in range(300))


def test_components_of_near_prints_with_hot_anchor(spark):
    """A ball of prints around one anchor, dealt into sub-blocks."""
    rng = np.random.default_rng(5)
    values = {int(v) for v in rng.integers(0, 1 << 62, 40)}
    for v in list(values):
        values |= {v ^ 1 << int(b) for b in rng.integers(46, 64, 12)} | {v ^ 1 << int(a) ^ 1 << int(b) for a, b in rng.integers(0, 64, (6, 2))}
    prints = list(enumerate(sorted(values)))
    signed = [(v if v < 1 << 63 else v - (1 << 64),) for _, v in prints]
    want = brute_components(prints)
    for block in (4, 50_000):
        edges = simhash.near_edges(spark.createDataFrame(signed, "fp long"), block=block)
        labels = {r.node % (1 << 64): r.label % (1 << 64) for r in simhash.least_labels(edges).collect()}
        groups = defaultdict(set)
        for i, v in prints:
            groups[labels.get(v, v)].add(i)
        assert sorted(map(sorted, groups.values())) == sorted(sorted(i for i, _ in prints if want[i] == c) for c in set(want.values()))


def test_long_chain_is_one_component(spark):
    edges = spark.range(0, 200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.label for r in simhash.least_labels(edges).collect()} == {0}
    assert simhash.least_labels(edges.filter("false")).count() == 0


def test_simhash_on_odd_documents(odd_docs, no_docs):
    rows = simhash.near_groups(odd_docs).collect()
    assert len(rows) == 12
    assert {r.component_id for r in rows if r.fp == 0} == {2}
    kept = simhash.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter({1: 1, 2: 1, 5: 1, 7: 1, 8: 2, None: 1})
    assert simhash.near_groups(no_docs).count() == 0 and simhash.keep_one(no_docs).count() == 0


# --- language identification ----------------------------------------------


def test_langid_query(spark, sf):
    docs = {r.doc_id: r for r in spark.read.parquet(sf + "/documents.parquet").collect()}
    rows = QUERIES["op4_langid"](spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
    held = [r for r in rows if r.held_out and docs[r.doc_id].lang]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) >= 0.95 * len(held)
    assert sum(r.accepted for r in rows) >= 0.95 * len(rows)


def test_langid_on_odd_documents(odd_docs, no_docs):
    model = langid.fit(odd_docs)
    rows = {r.doc_id: r for r in langid.identify(odd_docs, model, carry=("doc_id",)).collect()}
    assert {d for d, r in rows.items() if r.lang_pred == "und"} >= {2, 3, 4, 7}
    assert langid.identify(no_docs, langid.fit(no_docs), carry=("doc_id",)).count() == 0
    kept = langid.keep_identified(odd_docs)
    assert kept.columns == odd_docs.columns and not {2, 3, 4, 7} & {r.doc_id for r in kept.collect()}
    assert {r.lang_pred for r in langid.identify(odd_docs, langid.fit(no_docs), carry=("doc_id",)).collect()} == {"und"}


def test_langid_learns_what_it_sees():
    rows = [("der die das und nicht mit " * 5, "de"), ("the of and that with this " * 5, "en")] * 30
    model = langid.train(rows)
    assert model.predict("die und das nicht")[0] == "de" and model.predict("that and of the")[0] == "en"
    assert model.predict("12 !?") == ("und", 0.0) and langid.train(rows).logits.tobytes() == model.logits.tobytes()


# --- WARC ------------------------------------------------------------------


def brute_warc(pages):
    groups = defaultdict(list)
    for p, h in pages:
        groups[h or ""].append(p)
    out = []
    for h, ids in groups.items():
        raw, known = h.encode(), [p for p in ids if p is not None]
        head = max(known) if known else None
        first = True
        for p in ids:
            response = first and p == head
            first = first and not response
            out.append((p, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if response else "revisit", None if response else head))
    return sorted(out, key=str)


def test_warc_query_is_a_round_trip(spark, sf):
    pages = [(r.page_id, r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    assert sorted(map(tuple, QUERIES["op5_warc"](spark, sf).collect()), key=str) == brute_warc(pages)


def test_warc_chunks_and_odd_pages(spark, tmp_path):
    pages = [(1, "x" * 1000), (2, "x" * 1000), (3, None), (4, ""), (None, ""), (None, "only"), (5, "é" * 777), (5, "é" * 777), (6, "tail" * 64)]
    df = spark.createDataFrame([(p, f"http://h/ {p}\r\n", h, 1, "z") for p, h in pages], "page_id long, url string, html string, digest int, bytes string")
    manifest = warc.write_archives(df, chunk=64, file_bytes=500, folder=f"file://{tmp_path}/w")
    assert manifest.agg(F.sum("records")).first()[0] == len(pages)
    assert sorted(map(tuple, warc.read_archives(manifest).collect()), key=str) == brute_warc(pages)
    large = warc.write_archives(df.filter("page_id < 5"), min_bytes=100, folder=f"file://{tmp_path}/v")
    assert Counter(r.record_type for r in warc.read_archives(large).collect()) == {"response": 3, "revisit": 1}
    assert warc.read_archives(warc.write_archives(df.filter("false"))).count() == 0


def test_warc_of_a_huge_payload_and_many_equal_rows(spark, monkeypatch):
    """64 MB in one payload; rows that are equal in all columns, more than become rows at once; a digest of many pages."""
    monkeypatch.setattr(warc, "AT_ONCE", 7)
    monkeypatch.setattr(warc, "HOT", 3)
    huge = "0123456789abcdef" * (4 << 20)
    pages = [(1, huge), (2, "p"), (2, "p"), (3, "q"), *[(9, "same")] * 50, (8, "same"), (7, "same"), (6, "same")]
    df = spark.createDataFrame([(p, "u", h) for p, h in pages], "page_id long, url string, html string").repartition(3)
    got = sorted(map(tuple, warc.read_archives(warc.write_archives(df)).collect()), key=str)
    assert got == brute_warc(pages)
    assert sum(r[3] == "response" for r in got) == 4


# --- decontamination -------------------------------------------------------


def brute_distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        last, row = row, [i] + [0] * len(text)
        for j, d in enumerate(text, 1):
            row[j] = min(last[j - 1] + (c != d), last[j] + 1, row[j - 1] + 1)
    return min(row)


@settings(max_examples=150, deadline=None)
@given(st.text("abc", min_size=1, max_size=90), st.text("abc", max_size=120))
def test_myers_is_the_edit_distance(pattern, text):
    assert decontaminate.myers(pattern, text)[0] == brute_distance(pattern, text)


@settings(max_examples=60, deadline=None)
@given(st.text("ab ", min_size=12, max_size=40), st.lists(st.tuples(st.integers(0, 200), st.sampled_from("ab"), st.booleans()), max_size=5), st.text("ab ", max_size=30))
def test_pigeonhole_loses_nothing(item, edits, around):
    text = list(item)
    for at, c, cut in edits:
        at %= len(text) + 1
        text[at : at + cut] = [] if cut else [c]
    text = around + "".join(text) + around
    pattern = decontaminate.folded(item)
    if len(pattern) < 5:
        return
    found = decontaminate.Matcher([(1, item)], 0.2).find(text)
    near = brute_distance(pattern, decontaminate.folded(text))
    assert [d for _, d, _ in found] == ([near] if near <= int(len(pattern) * 0.2) else [])


def least_distance(pattern, text):
    """Least edit distance of the pattern to a substring, a column of the table at a time."""
    codes, steps = np.frombuffer(pattern.encode("utf-32-le"), np.uint32), np.arange(len(pattern) + 1)
    column = best = steps
    for c in np.frombuffer(text.encode("utf-32-le"), np.uint32):
        step = np.concatenate([[0], np.minimum(column[:-1] + (codes != c), column[1:] + 1)])
        column = np.minimum.accumulate(step - steps) + steps
        best = min(best if isinstance(best, int) else int(best[-1]), int(column[-1]))
    return best if isinstance(best, int) else int(best[-1])


def test_leaks_match_brute_force(spark, sf):
    docs = documents(spark, sf)
    items = [(r.item_id, decontaminate.folded(r.text)) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = {(r.doc_id, r.item_id): r.distance for r in QUERIES["op7_decontaminate"](spark, sf).collect()}
    assert got
    for d, t in docs:
        whole = decontaminate.folded(t)
        for i, x in items:
            if x in whole:
                assert got[d, i] == 0
    short = [(d, t) for d, t in docs if t and len(t) < 900]
    assert len(short) > 40
    for d, t in short:
        whole = decontaminate.folded(t)
        for i, x in items:
            near = least_distance(x, whole)
            assert got.get((d, i)) == (near if near <= int(len(x) * decontaminate.RATE) else None)


def test_short_items_have_edits_in_proportion():
    matcher = decontaminate.Matcher([(1, "what is the capital of peru now"), (2, "seven")])
    assert matcher.find("So: what is teh capital of peru, now?") == [(1, 2, 34)]
    assert matcher.find("what is it, seventh") == [] and [f[:2] for f in matcher.find("a seven b")] == [(2, 0)]


def test_decontaminate_on_odd_documents(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "Alpha, beta gamma DELTA epsilon zeta eta theta iota"), (2, None), (3, "short"), (None, "alpha beta gamma delta epsilon zeta eta theta iota")], "item_id int, text string")
    for size in (8_000_000, 10):
        rows = decontaminate.leaks(odd_docs, items, block_chars=size).collect()
        assert Counter((r.doc_id, r.item_id, r.distance) for r in rows) == {(1, 1, 0): 2, (1, None, 0): 2}
    kept = decontaminate.keep_clean(odd_docs, items, block_chars=10)
    assert kept.columns == odd_docs.columns and kept.count() == 10 and kept.filter("doc_id = 1").count() == 0
    assert decontaminate.leaks(no_docs, items).count() == 0 and decontaminate.leaks(odd_docs, items.filter("false")).count() == 0


# --- token shards ----------------------------------------------------------


def brute_tokens(docs, tokenizer):
    out, start = [], 0
    for d, t in docs:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_token_query_is_a_round_trip(spark, sf):
    from tokenizers import Tokenizer

    want = brute_tokens(sorted(documents(spark, sf)), Tokenizer.from_file(tokenizer_file()))
    assert sorted(map(tuple, QUERIES["op8_tokens"](spark, sf).collect())) == want


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([" ", "  ", "\n", "\t", "\xa0", " ", "\x1c", "\x85", "a", "Ab", "é", "中", "12", "'s", "!?", "<|endoftext|>", "​", "\U0001f600", "don't"]), max_size=14))
def test_chunks_encode_like_whole_texts(parts):
    from tokenizers import Tokenizer

    if not hasattr(test_chunks_encode_like_whole_texts, "made"):
        test_chunks_encode_like_whole_texts.made = tokens.Encoder(tokenizer_file()), Tokenizer.from_file(tokenizer_file())
    ours, theirs = test_chunks_encode_like_whole_texts.made
    text = "".join(parts)
    assert np.frombuffer(ours.encode([text])[0], ours.kind).tolist() == theirs.encode(text, add_special_tokens=False).ids


def test_shards_and_index(spark, odd_docs, no_docs):
    from tokenizers import Tokenizer

    manifest = tokens.write_tokens(odd_docs, tokenizer=tokenizer_file(), shard_ids=20)
    assert manifest.count() >= 3
    rows = sorted(map(tuple, tokens.read_tokens(manifest).collect()), key=lambda r: r[1])
    docs = sorted(((r.doc_id, r.text) for r in odd_docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    assert rows == brute_tokens(docs, Tokenizer.from_file(tokenizer_file()))
    found = tokens.lookup(manifest, [1, 5, 8, 99, 0])
    assert {k: len(v) for k, v in found.items()} == {1: 2, 5: 1, 8: 2}
    assert tokens.read_tokens(tokens.write_tokens(no_docs, tokenizer=tokenizer_file())).count() == 0


def test_one_id_over_many_shards(spark):
    """An id with most rows fills several shards; keyed access finds all its records and opens no other shard."""
    docs = spark.createDataFrame([(7, f"text {i} of a hot id") for i in range(300)] + [(i, f"own text {i}") for i in range(100)] + [(None, "no id")], "doc_id long, text string")
    manifest = tokens.write_tokens(docs.repartition(5), tokenizer=tokenizer_file(), shard_ids=200)
    assert manifest.filter("7 between least_key and greatest_key").count() > 3
    rows = {(r.doc_id, r.start): r for r in tokens.read_tokens(manifest).collect()}
    assert len(rows) == 401
    found = tokens.lookup(manifest, [7, 8, 99, 100])
    assert {k: len(v) for k, v in found.items()} == {7: 301, 8: 1, 99: 1}
    crc = lambda ids: zlib.crc32(ids.astype("<u4").tobytes())
    assert sorted(map(crc, found[7])) == sorted(r.ids_crc32 for (d, _), r in rows.items() if d == 7)


def test_long_and_odd_texts_encode_like_the_library():
    """Texts over a block, pieces over a key, new and foreign characters, and a table that starts anew."""
    from tokenizers import Tokenizer

    rng = np.random.default_rng(8)
    ours, theirs = tokens.Encoder(tokenizer_file()), Tokenizer.from_file(tokenizer_file())
    signs = list("abcdefghij  ABCé中ж0159'''.,\n\t\\xa0\\u3000—“½²\\U0001f600\\U0001faf8\\u200b\\u1c80") + ["'re", "'ll", "'ve", "'s", " 't", "'m", "'d"]
    texts = ["".join(rng.choice(signs, int(n))) for n in rng.integers(1, 300, 200)]
    texts += ["x" * 5000, "", " ", "plain words and more " * 70_000, "a" * 3_000_000 + " b", " ".join("".join(rng.choice(signs[:10], 30)) for _ in range(40_000))]
    for _ in range(2):
        assert ours.encode(texts) == [np.array(e.ids, ours.kind).tobytes() for e in theirs.encode_batch(texts, add_special_tokens=False)]
        ours.table.clear()


def test_perfect_hash():
    keys = np.random.default_rng(1).choice(1 << 40, 20_000, replace=False).astype(np.int64) - (1 << 39)
    index = tokens.PerfectHash.build(keys)
    assert sorted(index.slots(keys).tolist()) == list(range(20_000))
    assert len(tokens.PerfectHash.build(keys[:0]).slots(keys[:5])) == 5
    with pytest.raises(ValueError):
        tokens.PerfectHash.build(np.array([1, 1]))


# --- repeated strings ------------------------------------------------------


def brute_repeats(texts, n=repeats.LENGTH):
    """(bytes, removed, spans, digest) of each text, by a table of all windows."""
    seen = Counter(t[i : i + n] for t in texts for i in range(len(t) - n + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - n + 1):
            if seen[t[i : i + n]] > 1:
                gone[i : i + n] = True
        gone[len(t)] = False
        kept = bytes(np.frombuffer(t, np.uint8)[~gone[: len(t)]])
        out.append((len(t), int(gone.sum()), int((gone[:-1] & ~np.concatenate([[False], gone[:-2]])).sum()) if len(t) else 0, hashlib.sha256(kept).hexdigest()))
    return out


def test_repeats_query_matches_brute_force(spark, sf):
    docs = sorted(documents(spark, sf))
    want = brute_repeats([(t or "").encode() for _, t in docs])
    got = sorted(map(tuple, QUERIES["op9_repeats"](spark, sf).collect()))
    assert got == [(d, *w) for (d, _), w in zip(docs, want, strict=True)]


def planted(seed, n_docs=60):
    """Texts that share passages of about the threshold's length, in varied surroundings, also periodic ones."""
    rng = np.random.default_rng(seed)
    random = lambda n: bytes(rng.integers(97, 105, n, dtype=np.uint8))
    shared = [random(int(n)) for n in rng.integers(190, 420, 8)] + [b"ab" * 150, b"z" * 230]
    texts = []
    for _ in range(n_docs):
        parts = []
        for _ in range(int(rng.integers(0, 5))):
            s = shared[int(rng.integers(len(shared)))]
            a = int(rng.integers(0, 40))
            parts += [random(int(rng.integers(0, 150))), s[a : len(s) - int(rng.integers(0, 40))]]
        texts.append(b"".join([*parts, random(int(rng.integers(0, 250)))]).decode())
    return texts + texts[:3] + ["", "x" * 199, "x" * 200]


@pytest.mark.parametrize(("seed", "group"), [(1, 20_000), (2, 20_000), (3, 2), (4, 1), (5, 3), (6, 8)])
def test_planted_passages(spark, seed, group):
    texts = planted(seed)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(3)
    got = sorted(map(tuple, repeats.remove_repeats(df, group=group).drop("kept").collect()))
    assert got == [(i, *w) for i, w in enumerate(brute_repeats([t.encode() for t in texts]))]


def test_long_text_in_pieces(monkeypatch):
    """A text of many pieces chooses the same suffixes as one piece would."""
    text = bytes(np.random.default_rng(9).integers(97, 101, 30_000, dtype=np.uint8))
    whole = {tuple(map(int, x)) for part in repeats.document_suffixes([text]) for x in zip(*part, strict=True)}
    monkeypatch.setattr(repeats, "PIECE", 4096)
    cut = {tuple(map(int, x)) for part in repeats.document_suffixes([text]) for x in zip(*part, strict=True)}
    assert {x[1:3] for x in cut} == {x[1:3] for x in whole} and cut == whole


def test_pieces_give_each_suffix_once(monkeypatch):
    text = bytes(np.random.default_rng(10).integers(97, 101, 30_000, dtype=np.uint8))
    rows = lambda: [tuple(map(int, x)) for part in repeats.document_suffixes([text]) for x in zip(*part, strict=True)]
    whole = rows()
    monkeypatch.setattr(repeats, "PIECE", 4096)
    assert rows() == whole


def test_unique_text_of_several_pieces_stays_whole(spark):
    """Nothing in it occurs twice, so nothing goes; a passage planted on both sides of a cut goes in both places."""
    rng = np.random.default_rng(12)
    text = bytes(rng.integers(97, 123, 2 * repeats.PIECE + 5000, dtype=np.uint8)).decode()
    cut = repeats.PIECE - repeats.LENGTH
    twice = text[: cut - 150] + text[1000:1300] + text[cut + 150 :]
    got = {r.doc_id: r for r in repeats.remove_repeats(spark.createDataFrame([(1, text)], "doc_id int, text string")).collect()}
    assert (got[1].n_removed, got[1].n_spans, got[1].kept_sha256) == (0, 0, hashlib.sha256(text.encode()).hexdigest())
    (row,) = repeats.remove_repeats(spark.createDataFrame([(2, twice)], "doc_id int, text string")).collect()
    kept = twice[:1000] + twice[1300 : cut - 150] + twice[cut + 150 :]
    assert (row.n_removed, row.n_spans, row.kept_sha256) == (600, 2, hashlib.sha256(kept.encode()).hexdigest())


def test_repeats_on_odd_documents(odd_docs, no_docs):
    rows = repeats.remove_repeats(odd_docs).collect()
    assert len(rows) == 12
    assert all(r.n_removed == r.n_bytes for r in rows if r.doc_id in (5, 6)) and all(not r.n_removed for r in rows if r.n_bytes < 200)
    assert repeats.remove_repeats(no_docs).count() == 0
