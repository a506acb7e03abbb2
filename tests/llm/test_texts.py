import random
import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from samples import ODD, WORDS, prose
from netloom.llm import chat, crossentropy, decontaminate, fingerprint, language, packing, personal, pieces, sharding


def test_fingerprints_estimate_generalised_jaccard(spark, odd, empty):
    texts = [prose(k, 60) for k in range(40)] + [prose(3, 60), "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in fingerprint.fingerprints(docs).collect()}
    assert len(got) == len(texts) and got[3].fingerprint == got[40].fingerprint

    def like(x, y):
        a, b = Counter(x.split()), Counter(y.split())
        keys = a.keys() | b.keys()
        return sum(min(a[k], b[k]) for k in keys) / sum(max(a[k], b[k]) for k in keys) if keys else 1.0

    gaps = []
    for i, text in enumerate(texts):
        text = text or ""
        after = texts[i - 1] or "" if i else ""  # descending ids; after the last comes the first
        half = len(text) // 2
        edit = text[: len(text) - half] + after[:half]
        assert got[i].n_chars == len(text) and got[i].edited_sha256 == hashlib.sha256(edit.encode()).hexdigest()
        gaps += [got[i].near_edited - like(text, edit), got[i].near_next - like(text, after)]
    assert abs(np.mean(gaps)) < 0.02 and np.std(gaps) < 0.1
    assert fingerprint.fingerprints(odd).count() == odd.count() and fingerprint.fingerprints(empty).count() == 0


def test_weights_count(spark):
    docs = spark.createDataFrame([(2, "a " * 9 + "b"), (1, "a b")], "doc_id long, text string")
    got = fingerprint.fingerprints(docs, samples=128).where("doc_id = 2").first()
    assert abs(got.near_next - 2 / 10) < 0.12


def test_shards(spark, odd, empty):
    got = sharding.byte_shards(odd, shards=3).collect()
    assert len(got) == odd.count()
    sizes = {}
    for r in got:
        sizes.setdefault(r.shard, []).append(r)
    for rows in sizes.values():
        assert sorted(r.slot for r in rows) == list(range(len(rows)))
    by = {r.doc_id: r for r in got}
    assert by[0].size == 8 and by[0].text_crc32 == 0
    assert by[5].size == len(ODD[5].encode()) + 8 and by[5].text_crc32 == zlib.crc32(ODD[5].encode())
    assert sharding.byte_shards(empty).count() == 0
    even = spark.range(1000).selectExpr("id AS doc_id", "repeat('x', 10) AS text")
    counts = Counter(r.shard for r in sharding.byte_shards(even).collect())
    assert set(counts) == set(range(24)) and max(counts.values()) - min(counts.values()) <= 1


def test_language(spark, odd, empty):
    rows = [(k, " ".join(w + ("ung" if k % 2 else "tion") for w in prose(k, 8).split()), "de" if k % 2 else "en") for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs)
    got = language.identified(docs, model).withColumn("held", language.held_out()).collect()
    held = [r for r in got if r.held]
    assert held and all(r.held == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.95 and all(0 <= r.score <= 1 for r in got)
    out = language.identified(odd, model)
    assert out.columns == ["doc_id", "text", "n_shingles", "lang_pred", "score"]
    assert {r.doc_id for r in out.where("lang_pred = 'und'").collect()} == {0, 1, 2}
    assert language.identified(empty, language.fit(empty)).count() == 0
    nothing = language.fit(docs.where("lang = 'xx'"))
    assert {r.lang_pred for r in language.identified(docs, nothing).collect()} == {"und"}


def test_pieces_equal_the_library(spark, odd, empty):
    sp = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=pieces.DEFAULT_MODEL)
    got = pieces.encoded(odd).collect()
    for r in got:
        assert r.piece_ids == sp.encode(r.text or "") and r.n_pieces == len(r.piece_ids) and r.round_trip
    import pyarrow as pa

    texts = ["it's 12345.678 = foo_bar(baz)\r\n", "    deep\n        deeper " + " " * 40 + "x", "a" * 300, "▁▁ x▁", "ﬁ é"]
    ids, bounds = pieces.load(pieces.DEFAULT_MODEL).encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == sp.encode(texts)
    assert pieces.encoded(empty).count() == 0


def test_unigram_viterbi_equals_brute_force():
    import pyarrow as pa

    names = ["<unk>", "▁", "a", "b", "ab", "ba", "▁a", "bab", "aba", "▁ab"]
    scores = [0.0, -2.5, -2.0, -2.1, -3.0, -3.3, -3.1, -4.0, -4.4, -4.9]
    enc = pieces.Encoder(names, scores, {0}, {}, 0, "unigram")

    def best(word):
        table = [(0.0, [])]
        for end in range(1, len(word) + 1):
            table.append(max((table[a][0] + scores[names.index(word[a:end])], [*table[a][1], names.index(word[a:end])]) for a in range(end) if word[a:end] in names[1:]))
        return table[-1][1]

    words = ["ab", "abab", "babab", "aabbaab", "bbab"]
    ids, bounds = enc.encode(pa.array(words))
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [best("▁" + w) for w in words]


def test_packing_round_trip(spark, odd, empty):
    width = 256
    rows = packing.packed(odd, width=width).collect()
    whole = {}
    for r in rows:
        ids, at = np.frombuffer(r.input_ids, "<u2"), np.frombuffer(r.position_ids, "<u2")
        assert len(ids) == len(at) == width and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens <= width
        for doc, start, a, b in zip(r.doc_ids, r.doc_starts, r.cu_seqlens, r.cu_seqlens[1:]):
            assert at[a:b].tolist() == list(range(b - a))
            whole.setdefault(doc, []).append((start, ids[a:b].tolist()))
    expected = {}
    for r in pieces.encoded(odd).collect():
        expected.setdefault(r.doc_id, []).append(r.piece_ids)
    for doc, parts in whole.items():
        total = sorted(t for _, ids in parts for t in ids)
        assert total == sorted(t for ids in expected[doc] for t in ids)
        if len(expected[doc]) == 1:
            assert [t for _, ids in sorted(parts) for t in ids] == expected[doc][0]
    assert {d for d, ids in expected.items() if any(ids)} == set(whole)
    assert packing.packed(empty).count() == 0


def test_best_fit_equals_a_plain_search():
    rng = np.random.default_rng(0)
    for _ in range(20):
        width = int(rng.integers(1, 40))
        lengths = rng.integers(1, width + 1, 60).tolist()
        rows = packing.best_fit(lengths, width)
        assert sorted(p for row in rows for p in row) == list(range(60))
        free = []
        for size in sorted(lengths, reverse=True):
            fits = [k for k, f in enumerate(free) if f >= size]
            if fits:
                free[min(fits, key=lambda k: free[k])] -= size
            else:
                free.append(width - size)
        assert len(rows) == len(free) and sorted(width - sum(lengths[p] for p in row) for row in rows) == sorted(free)


PII = [
    ("write to a.b+c@mail-1.example.com, or @x.y, a@@b.c.d, q@nodot", ["email:9:32", "email:0:0"]),
    ("at 10.0.0.255 not 10.0.0.256 nor 1.2.3 but 1.2.3.4.5", None),
    ("card 4111 1111 1111 1111 and 4111-1111-1111-1112", None),
    ("call +1 (743) 555-3824 or +123", None),
    ("é𝒳 x@y.zz", None),
    ("a@b.c@d.e", None),
]


def plain_spans(text):
    """The contract's rules, word for word."""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), m.end(), "email"))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), m.end(), "ip"))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 14 <= len(d) <= 19 and sum(x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(d[::-1])) % 10 == 0:
            out.append((m.start(), m.end(), "card"))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((m.start(), m.end(), "phone"))
    return sorted(out, key=lambda s: (s[0], personal.KINDS.index(s[2])))


def test_personal_data(spark, odd, empty):
    rng = np.random.default_rng(4)
    noise = ["".join(rng.choice(list("ab0159@.+- ()%"), 60)) for _ in range(300)]
    texts = [t for t, _ in PII] + noise + [t or "" for t in ODD] + ["x@y " * 3000, "1" * 5000, "a" * 5000]
    for t in texts:
        assert personal.base_spans(t) == plain_spans(t)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in personal.digest(personal.found(docs)).collect():
        spans = plain_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(personal.joined(spans).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[2] == k for s in spans) for k in personal.KINDS]
        assert set(filter(None, personal.joined(spans).split(","))) <= set(r.spans.split(","))
    assert personal.found(odd).count() == odd.count() and personal.found(empty).count() == 0


def test_contexts_find_unseen_identifiers(spark):
    seeds = [f"please reach my phone: +1 (743) 555-{1000 + k} thanks {prose(k, 5)}" for k in range(30)]
    hidden = "please reach my phone: 555-38-24-99x thanks a lot"
    clean = "the year 20245678 was long"
    docs = spark.createDataFrame(list(enumerate([*seeds, hidden, clean])), "doc_id long, text string")
    got = {r.doc_id: r.spans for r in personal.digest(personal.found(docs)).collect()}
    assert got[30] == f"identifier:{hidden.index('555')}:{hidden.index(' thanks')}" and got[31] == ""
    masked = {r.doc_id: r.text for r in personal.masked(docs).collect()}
    assert masked[30] == "please reach my phone: <identifier> thanks a lot" and masked[31] == clean
    assert masked[0].startswith("please reach my phone: <phone> thanks")


def test_scores_equal_plain_counts(spark, odd, empty):
    texts = ["a b a c", "a b b", "", None, "c c d a b"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(0,), (1,), (1,)], "doc_id long")
    got = {r.doc_id: r for r in crossentropy.scored(docs, labels).collect()}
    size = len({w for t in texts for w in (t or "").split()})

    def losses(chosen, scale=1.0):
        pairs, heads = Counter(), Counter()
        for t in chosen:
            w = (t or "").split()
            pairs.update(zip([None, *w], w))
            heads.update([None, *w][: len(w)])

        def loss(text, own):
            w = text.split()
            bi, uni = (Counter(zip([None, *w], w)), Counter([None, *w][: len(w)])) if own else (Counter(), Counter())
            out = []
            for before, word in zip([None, *w], w):
                seen = scale * (heads[before] - uni[before]) + crossentropy.PRIOR
                out.append(-math.log((scale * (pairs[before, word] - bi[before, word]) + crossentropy.PRIOR / size) / seen))
            return sum(out) / len(out)

        return loss

    words = [len((t or "").split()) for t in texts]
    target, ground = losses(texts[:2]), losses(texts, sum(words[:2]) / sum(words))
    for i, t in enumerate(texts):
        if t:
            assert got[i].target_loss == pytest.approx(target(t, i < 2), rel=1e-6) and got[i].background_loss == pytest.approx(ground(t, True), rel=1e-6)
            assert got[i].score == pytest.approx(target(t, i < 2) - ground(t, True), abs=1e-5)
        else:
            assert got[i].n_tokens == 0 and got[i].score is None
    assert crossentropy.scored(odd, labels).count() == odd.count() and crossentropy.scored(empty, labels).count() == 0


def test_what_is_gathered_grows_and_frequent_events_are_counted_alike(spark, monkeypatch):
    rows = [(k, f"a b a b w{k} {prose(k, 40)}") for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k,) for k in range(0, 300, 7)], "doc_id long")
    few = crossentropy.fit(crossentropy._source(docs.where("doc_id < 100"), labels, "doc_id", "text"))
    model = crossentropy.fit(crossentropy._source(docs, labels, "doc_id", "text"))
    assert len(model.events) and model.entries > 2.5 * few.entries and model.vocabulary > few.vocabulary
    want = {r.doc_id: r.score for r in crossentropy.scored(docs, labels).collect()}
    # the same without a broadcast event, and in small groups
    monkeypatch.setattr(crossentropy, "SHARE", 2.0)
    monkeypatch.setattr(crossentropy, "GROUP", 1000)
    got = {r.doc_id: r.score for r in crossentropy.scored(docs, labels).collect()}
    assert got == pytest.approx(want, abs=1e-4)


def test_decontamination(spark, odd, empty):
    items = [prose(500 + k, 14 + 3 * k) for k in range(12)] + [None, ""]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    words = items[6].split()
    words[3::7] = ["changed"] * len(words[3::7])
    texts = [prose(900 + k, 200) for k in range(20)] + [f"{prose(70, 300)} {items[5].upper()}! {prose(71, 300)}", f"{prose(72, 50)} {' '.join(words)}", items[0], None, ""]
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, common string")
    index = decontaminate.fit(docs, bench)
    got = {r.doc_id: r for r in decontaminate.searched(docs, index).collect()}
    assert {i: r.item_ids for i, r in got.items() if r.contaminated} == {20: [5], 21: [6], 22: [0]}
    assert decontaminate.searched(empty, index).count() == 0
    none = decontaminate.fit(empty, bench.limit(0))
    assert decontaminate.searched(odd, none).where("contaminated").count() == 0


def test_paraphrases_are_found_in_a_large_table(spark):
    items = [prose(500 + k, 30) for k in range(10)]
    texts = [prose(10_000 + k, 20) for k in range(4000)]
    for k, item in enumerate(items):
        words = item.split()
        words[2::3] = [f"other{k}x{j}" for j in range(10)]
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    index = decontaminate.fit(docs, spark.createDataFrame(list(enumerate(items)), "item_id long, text string"))
    got = decontaminate.searched(docs, index).where("contaminated").collect()
    assert {r.doc_id: r.item_ids for r in got} == {4000 + k: [k] for k in range(10)}


def test_copies_are_found_with_many_items(spark):
    rng = np.random.default_rng(3)
    items = [" ".join(f"w{w}" for w in rng.integers(0, 6000, 40)) for _ in range(600)]
    docs = spark.createDataFrame([(k, f"two words {items[k]}") for k in range(0, 600, 10)], "doc_id long, text string")
    index = decontaminate.fit(docs, spark.createDataFrame(list(enumerate(items)), "item_id long, text string"), rank=32)  # for 2,400 passages
    got = decontaminate.searched(docs, index).where("contaminated").collect()
    assert {r.doc_id: r.item_ids for r in got} == {k: [k] for k in range(0, 600, 10)}


def test_longest_common_subsequence():
    rng = np.random.default_rng(1)
    for _ in range(50):
        x, y = rng.integers(0, 5, 12).tolist(), rng.integers(0, 5, 17).tolist()
        table = [[0] * 18 for _ in range(13)]
        for i, a in enumerate(x):
            for j, b in enumerate(y):
                table[i + 1][j + 1] = table[i][j] + 1 if a == b else max(table[i][j + 1], table[i + 1][j])
        assert decontaminate.common_length(x, y) == table[-1][-1]


def _talk(k, turns):
    out = [(k, 0, "system", "be brief\nand kind")]
    for t in range(1, turns):
        out.append((k, t, "user", f"{WORDS[t % 20]} why?") if t % 2 else (k, t, "assistant", prose(k * 1000 + t, 40) + "\n" + prose(t, 20)))
    return out


def test_chat_roles(spark, empty, monkeypatch):
    rows = [r for k in range(60) for r in _talk(k, 7)] + _talk(100, 1500)
    talks = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    model = chat.fit(talks)
    got = {(r.conv_id, r.turn): r for r in chat.parsed(talks, model).collect()}
    assert all(got[c, t].role == role and got[c, t].content == text for c, t, role, text in rows)
    # blocks give what one pass gives
    monkeypatch.setattr(chat, "BLOCK_ROWS", 10_000)
    one = {(r.conv_id, r.turn, r.part): (r.role, r.content) for r in chat.parsed(talks, model).collect()}
    assert one == {(r.conv_id, r.turn, r.part): (r.role, r.content) for r in got.values()}


def test_chat_markers_and_odd_rows(spark, empty):
    talks = spark.createDataFrame([r for k in range(60) for r in _talk(k, 7)], "conv_id long, turn long, role string, text string")
    model = chat.fit(talks)
    raw = "User: hello there\nAssistant: hi,\nwhat is it?\n### Human: bye"
    rows = spark.createDataFrame([(1, 0, raw), (2, 0, None), (None, None, "x"), (3, 0, "same"), (3, 0, "same")], "conv_id long, turn long, text string")
    got = chat.parsed(rows, model).collect()
    assert [(r.role, r.content) for r in sorted(got, key=lambda r: r.part) if r.conv_id == 1] == [("user", "hello there"), ("assistant", "hi,\nwhat is it?"), ("user", "bye")]
    assert sum(r.conv_id == 2 for r in got) == 1 and sum(r.conv_id is None for r in got) == 1 and sum(r.conv_id == 3 for r in got) == 2
    assert got[0].rendered == f"<|{got[0].role}|>\n{got[0].content}\n<|end|>"
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.parsed(none, chat.fit(none)).count() == 0


def test_short_items_and_what_brute_force_finds(spark):
    rng = random.Random(3)
    items = [prose(3000 + n, n) for n in range(3, 25)]
    other = [f"z{k}" for k in range(400)]
    texts = [f"{' '.join(rng.choices(other, k=60))} {item} {' '.join(rng.choices(other, k=60))}" for item in items] + [" ".join(rng.choices(other, k=200)) for _ in range(10)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {r.doc_id: set(r.item_ids) for r in decontaminate.searched(docs, decontaminate.fit(docs, bench)).collect()}
    # every item against every window twice its length, without the index
    for i, text in enumerate(texts):
        words = text.split()
        for k, item in enumerate(items):
            wanted = item.split()
            best = max(decontaminate.common_length(wanted, words[a : a + 2 * len(wanted)]) for a in range(len(words)))
            if best == len(wanted):
                assert k in got[i]
            elif best < decontaminate.COMMON * len(wanted):
                assert k not in got[i] or decontaminate.common_length(wanted, words) >= decontaminate.COMMON * len(wanted)
    assert all(not got[i] for i in range(len(items), len(texts)))


def test_very_long_texts_take_seconds():
    from time import time

    import pyarrow as pa
    import sentencepiece

    codec = pieces.load(pieces.DEFAULT_MODEL)
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.DEFAULT_MODEL)
    began = time()
    for text in ("7" * 1_000_000, "1." * 500_000, "+1 " * 300_000, "a@" * 500_000):
        assert all(0 <= a < b <= len(text) for a, b, _ in personal.base_spans(text))
        personal.candidate_spans(text, [])
    assert time() - began < 20
    for text in (" " * 20_000 + "end", "ab" * 10_000, "x" * 5_000 + "  y"):
        ids, _ = codec.encode(pa.array([text]))
        assert ids.tolist() == library.encode(text)
    began = time()
    codec.encode(pa.array([" " * 300_000, "ab" * 150_000]))
    assert time() - began < 20


def test_contexts_reach_over_any_distance():
    text = "left " + "-" * 400 + " 555 0199 1234 " + " " * 300 + "right"
    at = text.index("555")
    assert personal.Words(text).near(at, at + 13) == (["left", "-" * 400], ["right"])
    assert personal.Words("id:123 x").near(3, 6) == (["id:"], ["x"])
