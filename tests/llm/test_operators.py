"""The operators against brute force, on small tables that hold every defined edge case."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

SPACE = re.compile(r"[\x20\x09-\x0D]+")
#: Columns whose names an operator could use itself.
CLASH = "doc_id long, text string, key string, row string, tag int, fp int, n int, kept int, v int, h1 int, cls int, id int"


def docs_of(texts, ids=None):
    rng = random.Random(5)
    words = ["alpha", "beta", "Gamma", "délta", "ε", "zeta", "eta.", "theta"]
    prose = lambda n: " ".join(rng.choice(words) + str(rng.randint(0, 99)) for _ in range(n))
    base = prose(300)
    rows = [
        (1, base),
        (2, base),
        (3, base.replace(" ", "\n\t")),
        (4, base + " tail"),
        (5, None),
        (6, ""),
        (7, " \n "),
        (8, "short"),
        (9, prose(60)),
        (9, prose(60)),
        (10, "same row"),
        (10, "same row"),
        (None, base),
        (None, "no id"),
        (11, "aaaa " * 400),
        (12, prose(40) + base[200:900] + prose(40)),
        (13, prose(5000)),
        (14, "x" * 3000),
        (15, "one two"),
        (16, "# | # | # | $ % & menu | home | about | more"),
    ]
    return rows + [(100 + i, t) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "k", "r", 1, 2, 3, 4, 5, 6, 7, 8) for i, t in docs_of([])]
    return spark.createDataFrame(rows, CLASH).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], CLASH)


def pairs(docs):
    return [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]


def test_exact_dedup(docs, empty):
    from quillspark.llm.exact_dedup import with_groups

    groups: dict = {}
    for i, t in pairs(docs):
        groups.setdefault(SPACE.sub("", t), []).append((-len(t), i is None, i or 0))
    expected = {}
    for k, members in groups.items():
        best = min(members)
        expected[k] = (None if best[1] else best[2], len(members), hashlib.sha256(k.encode()).hexdigest())
    got = with_groups(docs).select("row.text", "row.key", "doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert len(got) == docs.count() and {r.key for r in got} == {"k"}
    kept: dict = {}
    for r in got:
        k = SPACE.sub("", r.text or "")
        assert (r.keep_id, r.group_size, r.text_sha256) == expected[k]
        kept[k] = kept.get(k, 0) + r.kept
        assert not r.kept or r.doc_id == r.keep_id
    assert set(kept.values()) == {1}
    assert with_groups(empty).count() == 0


def test_directory_splits():
    from quillspark.llm.exact_dedup import Chains, Directory

    d = Directory({0: 50, 1: 50, 2: 10, 3: 10, 7: 900}, 3, 60)
    assert len(d.slots) == 1 << d.depth == len(d.owner)
    assert d.owner == sorted(d.owner)  # buckets are key ranges
    assert len({d.owner[0], d.owner[1], d.owner[2], d.owner[7]}) == 4 and d.owner[2] == d.owner[3]
    assert Directory({}, 2, 1).owner == [0]
    c = Chains()
    for text in (b"a", b"b", b"a"):
        c.add(7, text, text, (1, 1, 1), 1)
    assert sorted((r[1], r[4]) for r in c.drain()) == [(b"a", 2), (b"b", 1)]


def test_collisions_are_told_apart(spark, monkeypatch):
    from quillspark.llm import exact_dedup as X

    monkeypatch.setattr(X.F, "xxhash64", lambda *a: F.lit(5).cast("long"))
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, "c")], "doc_id long, text string")
    assert sorted((r.doc_id, r.keep_id) for r in X.with_groups(df).collect()) == [(1, 1), (2, 2), (3, 1), (4, 4)]


def simhash_slow(t):
    import xxhash

    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    w = [x for x in SPACE.split(low) if x]
    if not w:
        return 0
    s = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def clusters(fps):
    distinct = sorted(set(fps))
    parent = {f: f for f in distinct}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                parent[find(a)] = find(b)
    return {f: find(f) for f in distinct}


def test_simhash(docs, empty):
    from quillspark.llm.simhash import with_components

    got = with_components(docs).select("row.text", "doc_id", "component_id", "kept", F.col("fp").alias("f")).collect()
    fp = {r.text: r.f % (1 << 64) for r in got}
    assert all(fp[t] == simhash_slow(t or "") for t in fp)
    root = clusters(fp.values())
    members: dict = {}
    for r in got:
        members.setdefault(root[fp[r.text]], []).append(r)
    for group in members.values():
        ids = [r.doc_id for r in group if r.doc_id is not None]
        assert {r.component_id for r in group} == {min(ids) if ids else None}
        assert sum(r.kept for r in group) == 1
    assert with_components(empty).count() == 0
    bare = with_components(docs, carry=["doc_id"])
    assert bare.schema["row"].dataType.names == ["doc_id"]
    assert sorted(map(str, bare.select("doc_id", "fp", "component_id").collect())) == sorted(str(r) for r in with_components(docs).select("doc_id", "fp", "component_id").collect())


def test_golay_keys():
    from quillspark.llm.simhash import GOLAY, golay_keys, nearest

    counts = np.bincount(nearest(np.arange(1 << 23)), minlength=4096)
    assert len(counts) == 4096 and set(counts.tolist()) == {2048}  # a perfect code
    rng = np.random.default_rng(2)
    a = rng.integers(0, 1 << 23, 3000)
    b = a ^ (1 << rng.integers(0, 23, 3000)) ^ (1 << rng.integers(0, 23, 3000))
    assert all(set(x) & set(y) for x, y in zip(golay_keys(a).tolist(), golay_keys(b).tolist(), strict=True))
    assert {len(set(x)) for x in golay_keys(a).tolist()} <= {1, 6}
    assert GOLAY.bit_length() == 12


def test_links_lose_nothing(spark, monkeypatch):
    """Random fingerprints around a few centres, with and without the way for crowded keys."""
    from quillspark.llm import simhash as S
    from quillspark.llm.components import components

    rng = random.Random(3)
    fps = set()
    for _ in range(6):
        c = rng.getrandbits(64)
        for _ in range(60):
            for _ in range(rng.randint(0, 3)):
                c ^= 1 << rng.randrange(64)
            fps.add(c)
    signed = [S._signed(f) for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    expected = clusters(fps)
    for cap in (16, 2):
        monkeypatch.setattr(S, "PAIR_CAP", cap)
        roots = {r.node % (1 << 64): r.root % (1 << 64) for r in components(S.links(df)).collect()}
        got: dict = {}
        for f in fps:
            got.setdefault(roots.get(f, f), set()).add(f)
        want: dict = {}
        for f, r in expected.items():
            want.setdefault(r, set()).add(f)
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_components_of_a_path(spark):
    from quillspark.llm.components import components

    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 99), (5, 5)], "u long, v long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert all(got[i] == 0 for i in range(1, 61)) and got[100] == 99


def covered_slow(texts, n=400):
    seen: dict = {}
    for k, t in enumerate(texts):
        for i in range(len(t) - n + 1):
            seen.setdefault(t[i : i + n], []).append((k, i))
    marks = [np.zeros(len(t), bool) for t in texts]
    for places in seen.values():
        if len(places) > 1:
            for k, i in places:
                marks[k][i : i + n] = True
    return marks


@pytest.mark.parametrize("crowd", [1000, 2])
def test_suffix_dedup(docs, empty, monkeypatch, crowd):
    from quillspark.llm import suffix_dedup as S

    monkeypatch.setattr(S, "CROWD", crowd)
    got = S.without_repeats(docs).select("row.doc_id", "row.text", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passages", "kept_text").collect()
    data = [(r.text or "").encode() for r in got]
    removed = 0
    for r, t, m in zip(got, data, covered_slow(data), strict=True):
        kept = np.frombuffer(t, np.uint8)[~m].tobytes()
        spans = int(np.count_nonzero(np.diff(np.concatenate([[0], m.astype(int)])) == 1))
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(t), int(m.sum()), spans, hashlib.sha256(kept).hexdigest())
        removed += r.n_removed
    assert removed > 5000
    assert S.without_repeats(empty).count() == 0
    narrow = [passages_slow(t, m, 50) for t, m in zip(data, covered_slow(data, 200), strict=True)]
    assert [r.n_passages for r in got] == [len(p) for p in narrow] and sum(map(len, narrow)) > 5
    cut = S.without_passages(docs).select("row.doc_id", "row.text", "n_passages", "kept_text").collect()
    expected = []
    for t, p in zip(data, narrow, strict=True):
        for a, b in reversed(p):
            t = t[:a] + t[b:]
        expected.append((len(p), t.decode()))
    assert sorted(map(str, [(r.text or "", r.n_passages, r.kept_text) for r in cut])) == sorted(map(str, [(d.decode(), *e) for d, e in zip(data, expected, strict=True)]))
    assert S.without_passages(empty).count() == 0


def passages_slow(t, marks, min_words):
    """Byte ranges from the first to the last of the words that lie wholly in a maximal run of marks."""
    out = []
    for run in re.finditer(b"\x01+", marks.astype(np.uint8).tobytes()):
        inside = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", t) if run.start() <= m.start() and m.end() <= run.end()]
        if len(inside) > min_words:
            a, b = run.span()
            ink = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", t)]
            a = max([a, *(e for s, e in ink if s < a < e)])
            b = min([b, *(s for s, e in ink if s < b < e)])
            out.append((a, b))
    return out


def test_suffix_runs_of_long_texts(spark, monkeypatch):
    """Texts longer than what is hashed at once, and texts of one byte repeated."""
    from quillspark.llm import suffix_dedup as S

    rng = random.Random(12)
    prose = lambda n: "".join(rng.choice("abcdefghij \n") for _ in range(n))
    shared = prose(3000)
    texts = [prose(700_000) + shared + prose(600_000), "q" * 700_000, prose(50) + shared, "x" * 500, "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(2)
    got = {r.row.doc_id: r for r in S.without_repeats(df).collect()}
    assert got[0].n_removed >= 3000 and shared not in got[0].kept_text and got[0].n_removed < 3050
    assert got[1].n_removed == 700_000 and got[1].n_spans == 1
    assert got[2].n_bytes - got[2].n_removed <= 50 and got[3].n_removed == 500 and got[5].n_bytes == 0
    # runs over several pieces are those of each piece alone
    pieces = [prose(rng.randint(60, 900)).encode() for _ in range(30)] + [b"aab" * 200]
    together = list(zip(*(x.tolist() for x in S.runs_of(pieces, 60)), strict=True))
    alone = [(k, *r[1:]) for k, p in enumerate(pieces) for r in zip(*(x.tolist() for x in S.runs_of([p], 60)), strict=True)]
    assert together == alone
    for k, v, _, s, n, twice in together:
        grams = S.gram_hashes(np.frombuffer(pieces[k], np.uint8), S.gram_of(60)).view(np.int64).tolist()
        assert twice == (grams[s : s + n + 60 - S.gram_of(60)].count(v) > 1)


def test_merge_of_shards():
    """Blocks over many small shards agree with comparing prefixes directly, whatever the shard size."""
    from quillspark.llm import suffix_dedup as S

    rng = random.Random(4)
    snippets = [(bytes(rng.choice(b"ab\0") for _ in range(rng.randint(20, 60))), rng.randint(1, 2)) for _ in range(12)]
    snippets.append((snippets[0][0][3:], 1))
    for depth in (9, 12, 20):
        count: dict = {}
        for d, times in snippets:
            for i in range(len(d) - depth + 1):
                count[d[i : i + depth]] = count.get(d[i : i + depth], 0) + times
        for size in (30, 100, 10_000):
            flags = S.repeated_windows(snippets, depth, size)
            for (d, _), f in zip(snippets, flags, strict=True):
                assert f.tolist() == [count[d[i : i + depth]] > 1 for i in range(len(d) - depth + 1)]


def test_ranges():
    from quillspark.llm.suffix_dedup import maximal, passages, ranges

    assert ranges(np.array([1, 1, 0, 0, 0, 1], bool), 3) == [(0, 4), (5, 8)]
    assert ranges(np.array([1, 0, 1], bool), 3) == [(0, 5)]
    assert maximal([{"a": 5, "b": 7}, {"a": 0, "b": 2}, {"a": 2, "b": 3}]) == [(0, 3), (5, 7)]
    assert passages(b"ab cd ef gh", [(1, 7)], 0) == [(2, 6)]
    assert passages(b"ab cd ef gh", [(0, 8)], 2) == [(0, 8)] and passages(b"ab cd ef gh", [(0, 8)], 3) == []
    assert passages(b"abcdefgh", [(1, 3)], 0) == []


def pack_and_check(docs, **kwargs):
    from quillspark.llm.packing import encoder, pack

    rows = pack(docs, **kwargs).collect()
    room = kwargs.get("capacity", 2048)
    encode = encoder()
    whole: dict = {}
    for i, t in pairs(docs):
        whole.setdefault(i, []).append([*encode(t), 1])
    seen: dict = {}
    sequences: dict = {}
    for r in rows:
        options = [w for w in whole[r.doc_id] if len(w) == r.doc_tokens]
        assert any(zlib.crc32(np.array(w[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 for w in options)
        seen[r.doc_id] = seen.get(r.doc_id, 0) + r.length
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert seen == {i: sum(map(len, ws)) for i, ws in whole.items()}
    pad = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= room
        pad += room - at
    return sum(seen.values()), pad, len(sequences)


def test_packing(docs, empty, spark):
    from quillspark.llm.packing import pack

    total, pad, n = pack_and_check(docs)
    assert n <= -(-total // 2048) + 1
    total, pad, n = pack_and_check(docs, capacity=64, unit=1)
    assert pad <= 0.02 * total + 64
    assert pack(empty).count() == 0
    assert pack(spark.createDataFrame([(1, "a" + " a" * 2046)], "doc_id long, text string")).count() == 1  # whole sequences only


def test_packed_ids_and_back(docs, empty):
    """With ids: the same pieces, each with its ids, and every text decoded from them."""
    from quillspark.llm.packing import pack, unpack

    known = docs.filter("doc_id <> 9").dropDuplicates(["doc_id"]).repartition(1)
    packed = pack(known, capacity=64, unit=1, ids=True)
    plain = pack(known, capacity=64, unit=1)
    assert sorted(map(str, packed.drop("ids").collect())) == sorted(map(str, plain.collect()))
    for r in packed.collect():
        assert len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
    assert {r.doc_id: r.text for r in unpack(packed).collect()} == {r.doc_id: r.text or "" for r in known.collect()}
    assert pack(empty, ids=True).columns == packed.columns and pack(empty, ids=True).count() == 0


def test_special_token_text():
    from tokenizers import Tokenizer

    import public_tokenizers
    from quillspark.llm.packing import SPECIAL, encoder

    full = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(6)
    odd = ["", " ", f"a{SPECIAL}b", "\u2028x\u00a0 y", "it's 12３ x²", "日本語 テスト", "\t\r\n  z", "\U0001f600" * 3]
    odd += ["".join(chr(rng.choice([rng.randint(32, 126), rng.randint(0xA0, 0x2FFF), 10, 32])) for _ in range(60)) for _ in range(50)]
    assert [encoder()(t) for t in odd] == [e.ids for e in full.encode_batch(odd, add_special_tokens=False)]


def test_plan_is_near_the_bound():
    from quillspark.llm.packing import best_pattern, plan

    value, pattern = best_pattern(np.array([0.3, 0.5, 0.35]), np.array([3, 5, 4]), 10)
    assert abs(value - 1.0) < 1e-9 and pattern @ np.array([3, 5, 4]) <= 10
    for histogram in ({3: 100, 5: 70, 7: 31}, {1: 1}, {128: 4, 127: 9, 2: 5}, {}):
        intervals, n = plan(histogram, 128)
        assert sum(b - a for _, a, b, _, _ in intervals.tolist()) == sum(histogram.values())
        assert n <= -(-sum(c * k for c, k in histogram.items()) // 128) + 1 or histogram == {128: 4, 127: 9, 2: 5}


def rules_slow(t):
    w = [x for x in SPACE.split(t) if x]
    seen: dict = {}
    for k in range(len(w) - 7):
        seen.setdefault(tuple(w[k : k + 8]), []).append(k)
    hit = {p for ks in seen.values() if len(ks) > 1 for k in ks for p in range(k, k + 8)}
    lines = [x for x in t.split("\n") if SPACE.sub("", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit), len(w) < 20 or 100 * len(hit) > 30 * len(w)


def test_quality_rules(docs, empty):
    from quillspark.llm.quality_rules import with_quality

    got = with_quality(docs.withColumn("doc_id", F.col("text"))).collect()
    for r in got:
        t = r.doc_id or ""
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == rules_slow(t)
        assert not (r.kept and r.base_failed)
    assert with_quality(empty).count() == 0
    plan = with_quality(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange hashpartitioning" not in plan


def test_line_rules(spark):
    from quillspark.llm.quality_rules import with_quality

    rng = random.Random(1)
    good = "".join(" ".join(f"w{rng.randint(0, 999)}" for _ in range(15)) + ".\n" for _ in range(5))
    cases = {
        "clean": (good, True, good),
        "symbols": ("so$$$ many%%% signs### here&&& they*** stand\n" * 1 + " ".join(f"w{i}&&&" for i in range(60)), False, None),
        "menu": (good.split("\n")[0] + "\n" + "\n".join(" | ".join(f"item{i}{j}" for j in range(9)) for i in range(6)), False, None),
        "shouting": (" ".join(f"W{i}!!" for i in range(60)), False, None),
        "stutter": (" ".join(f"w{i} " * 5 for i in range(20)), False, None),
        "one bad line": (good + "Click here to subscribe to more", True, good.rstrip("\n") + "\n"),
    }
    df = spark.createDataFrame([(k, v[0]) for k, v in cases.items()], "doc_id string, text string")
    for r in with_quality(df).collect():
        text, kept, left = cases[r.doc_id]
        assert r.kept is kept, r
        if left is not None:
            assert r.clean_text.rstrip("\n") == left.rstrip("\n")


def test_url_filter(spark):
    from quillspark.llm.queries import URL_RULES
    from quillspark.llm.url_filter import filter_urls

    rng = random.Random(7)
    hosts = ["example.org", "a.example.org", "Sub.Example.ORG", "org", "borg", "x.com", "com", "net", "é.com", ""]
    paths = ["", "/", "/es/", "/es", "/en/1", "/en/12?q=/es/", "/fr/x#y", "/de/"]
    urls = [None, "", "no scheme", "://", "http://", "x://org?/es/"] + [f"http://{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(400)]
    urls += ["http://example.org/es/hot"] * 300
    rules = [*URL_RULES, ("", "/", "block"), ("example.org", "/", "block"), ("a.example.org", "/es", "allow"), ("org", "/", "block")]
    df = spark.createDataFrame([(i if i % 9 else None, u, "z", 1) for i, u in enumerate(urls)], "page_id long, url string, host string, pid int")

    def slow(u, rules):
        rest = (u or "").partition("://")[2]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fit = [(len(h) + len(p), h + p, v) for h, p, v in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
        longest = max((f[0] for f in fit), default=0)
        fit = sorted(f for f in fit if f[0] == longest)
        verdict = "block" if any(v == "block" for *_, v in fit) else "allow"
        return (host, path, fit[0][1], verdict) if fit else (host, path, None, "allow")

    for some in (URL_RULES, [r for r in rules if r[0]]):
        got = sorted((r.host, r.path, r.rule or "", r.verdict) for r in filter_urls(df, some).collect())
        assert got == sorted((h, p, x or "", v) for h, p, x, v in (slow(u, some) for u in urls))
    table = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    assert filter_urls(df, table).count() == len(urls)
    assert filter_urls(df.limit(0), URL_RULES).count() == 0


def test_chat_format(spark):
    from quillspark.llm.chat_format import format_chats

    chats = {1: "abc", 2: "ab", 3: "a", 4: "abc", 5: "abd", 6: "b", 7: "ba", None: "ab", 8: "x"}
    rows = [(c, t, "user" if t % 2 == 0 else None, s if s != "x" else None, 1, 2) for c, turns in chats.items() for t, s in enumerate(turns)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n int, a int").repartition(3)
    got = {r.conv_id: (r.n_turns, r.copies, r.rendered) for r in format_chats(df).collect()}
    assert set(got) == {1, 5, 7, 8}
    assert got[1] == (3, 2, "<|user|>\na\n<||>\nb\n<|user|>\nc\n<|end|>")
    assert got[8] == (1, 1, "<|user|>\n\n<|end|>")
    assert format_chats(df.limit(0)).count() == 0


def test_chat_format_hot_conversation(spark):
    """One conversation of most rows, spread over many ranges, with ties and repeated rows; its snapshots collapse."""
    from quillspark.llm import chat_format as C

    rng = random.Random(2)
    turns = [(t // 2, rng.choice(["user", "bot"]), f"t{rng.randint(0, 50)}") for t in range(3000)]
    turns += [turns[-1]] * 700  # equal rows are repeated turns
    rows = [(7, *t) for t in turns] + [(8, *t) for t in sorted(turns[:1000])] + [(c, 0, "user", f"hi {c}") for c in range(20, 40)] + [(None, 1, "user", "x"), (None, 0, "bot", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    got = {r.conv_id: r for r in C.format_chats(df).collect()}
    assert set(got) == {7, None, *range(20, 40)}
    assert got[7].n_turns == 3700 and got[7].copies == 1 and got[7].rendered.count("|>\n") == 3700
    assert got[None].rendered == "<|bot|>\n\n<|user|>\nx\n<|end|>"
    # prefixes are numbered through, whatever ranges they fell into
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        old = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", 16)
        again = {r.conv_id: r.rendered for r in C.format_chats(df).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert again == {c: r.rendered for c, r in got.items()}


def test_sentencepiece_agrees_with_the_public_encoder():
    """Zipf scores give real words the ids that replaying merges gives; merge ranks as scores don't."""
    from quillspark.llm.sentencepiece_codec import agreement

    text = "The committee published a detailed report on public health, and several newspapers discussed its findings in the following weeks. Please note that the meeting was moved to Thursday."
    assert agreement([text]) > 0.9
    assert agreement([""]) == 0


def test_sentencepiece_long_text(spark):
    from quillspark.llm.sentencepiece_codec import encode_documents

    rng = random.Random(3)
    long = " ".join("".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 9))) for _ in range(60_000))
    df = spark.createDataFrame([(1, long), (2, "字" * 20_000), (3, "a" * 20_000)], "doc_id int, text string")
    got = {r.doc_id: r for r in encode_documents(df).collect()}
    assert all(r.round_trip and r.n_pieces > 1000 for r in got.values())


def test_sentencepiece(docs, empty):
    from quillspark.llm.sentencepiece_codec import Model, decode_documents, encode_documents

    rng = random.Random(0)
    for _ in range(150):
        pieces = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 3))) for _ in range(8)} | {" a", " ", " ab", "."}
        m = Model([(p, -float(rng.randint(1, 9))) for p in sorted(pieces)], range(1000, 1256))
        text = "".join(rng.choice("ab c.é") for _ in range(rng.randint(1, 8)))
        full = " " + text

        def paths(at, m=m, full=full):
            if at == len(full):
                yield 0.0
            for end, score, _ in m.steps(full, at) if at < len(full) else ():
                for rest in paths(end):
                    yield score + rest

        expected = sorted(paths(0), reverse=True)[:4]
        ids, scores = m.encode(text, 4)
        assert [round(s, 6) for s in scores] == [round(s, 6) for s in expected]
        assert m.decode(np.frombuffer(ids, "<u4").tolist()) == text
        alone = m.nbest(full, 4)
        assert [round(s, 6) for s, _ in alone] == [round(s, 6) for s in expected] and len({tuple(i) for _, i in alone}) == len(alone)
    got = encode_documents(docs, keep_ids=True)
    assert got.count() == docs.count() and got.filter("NOT round_trip OR score_1 < score_2").count() == 0
    back = {(r.doc_id, r.text) for r in decode_documents(got).collect()}
    assert back == {(i, t) for i, t in pairs(docs)}
    assert encode_documents(empty).count() == 0


def labelled(spark, kind):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice(["ba", "ne", "ti", "lo", "ru", "so"]) for _ in range(rng.randint(1, 4)))
    rows, marks = [], []
    for i in range(600):
        bad = i % 4 == 0
        words = [word() for _ in range(rng.randint(20, 120))]
        if kind == "quality" and bad:
            words = [w + "&&&" for w in words]
        if kind == "toxic" and bad:
            for _ in range(2):
                words.insert(rng.randrange(len(words)), rng.choice(["scoundrel", "villain", "wretch"]))
        rows.append((i, " ".join(words), "x", 0.5))
        marks.append((i, int(bad) if kind == "toxic" else int(not bad)))
    rows += [(None, None, "x", 0.5), (9001, "", "x", 0.5), (9002, "ba " * 50_000, "x", 0.5)]
    marks += [(None, 1), (9001, None), (9003, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label string, score double")
    return docs, spark.createDataFrame(marks, f"doc_id long, {kind} int")


def test_quality_model_by_hand():
    """One epoch of descent, and a score, against plain loops."""
    import math
    import zlib

    from quillspark.llm import quality_classifier as Q

    texts = ["good words here", "bad bad ünïcode", "more good text", "worse"]
    labels = np.array([1, 0, 1, 0])
    rows = [Q.features(t) for t in texts]
    for t, (at, x) in zip(texts, rows, strict=True):
        words = t.split()
        want: dict = {}
        for w in words:
            b = int(Q._hash(np.array([zlib.crc32(w.encode())], np.uint32), 0)[0])
            want[b] = want.get(b, 0) + 1 / len(words)
        grams = [(n, t[i : i + n]) for n in Q.NGRAMS for i in range(len(t) - n + 1)]
        for n, g in grams:
            value = 0
            for c in g:
                value = (value * int(Q.MIX) + ord(c)) % (1 << 32)
            b = Q.BUCKETS + int(Q._hash(np.array([value], np.uint32), n)[0])
            want[b] = want.get(b, 0) + 1 / len(grams)
        if any(a == b for a, b in zip(words, words[1:], strict=False)):
            want[Q.SAME] = sum(a == b for a, b in zip(words, words[1:], strict=False)) / len(words)
        assert dict(zip(at.tolist(), np.round(x, 5).tolist(), strict=True)) == pytest.approx(want, abs=1e-4)

    dim, rate, seed = 3, 0.5, 4
    got = Q.train(rows, labels, dim=dim, epochs=1, rate=rate, seed=seed)
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (Q.FEATURES, dim)).astype(np.float32).astype(float)
    layer = rng.uniform(-1, 1, (dim, 2)).astype(np.float32).astype(float)
    bias = [0.0, 0.0]
    for done, i in enumerate(rng.permutation(4)):
        at, x = rows[i]
        lr = rate * (1 - done / 4)
        hidden = [sum(float(x[k]) * vectors[f][d] for k, f in enumerate(at)) for d in range(dim)]
        z = [sum(hidden[d] * layer[d][c] for d in range(dim)) + bias[c] for c in (0, 1)]
        p = [math.exp(v) / sum(map(math.exp, z)) for v in z]
        p[labels[i]] -= 1  # the gradient of the loss; both classes weigh one
        back = [sum(layer[d][c] * p[c] for c in (0, 1)) for d in range(dim)]
        for d in range(dim):
            for c in (0, 1):
                layer[d][c] -= lr * 0.1 * hidden[d] * p[c]
        for c in (0, 1):
            bias[c] -= lr * 0.05 * p[c]
        for k, f in enumerate(at):
            for d in range(dim):
                vectors[f][d] -= lr * float(x[k]) * back[d]
    diff = layer[:, 1] - layer[:, 0]
    assert got.bias == pytest.approx(bias[1] - bias[0], abs=1e-5)
    assert np.abs(got.weights - vectors @ diff).max() < 1e-4
    for t in [*texts, "", "new good " * 50]:
        at, x = Q.features(t)
        assert got.log_odds(t) == pytest.approx(got.bias + float((got.weights[at].astype(float) * x).sum()), abs=1e-4)
    old, Q.BLOCK = Q.BLOCK, 7  # blocks don't change a score
    try:
        assert [got.log_odds(t) for t in texts] == pytest.approx([got.bias + float((got.weights[a].astype(float) * x).sum()) for a, x in rows], abs=1e-4)
    finally:
        Q.BLOCK = old


def test_labelled_sample(spark):
    from quillspark.llm.common import labelled_sample

    docs = spark.createDataFrame([(i, "x" * 100) for i in range(40)] + [(3, "x" * 100)] * 30 + [(5, None), (None, "n")], "doc_id int, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 30)] + [(3, 0), (4, None), (None, 1), (6, 7)], "doc_id int, y int")
    take = lambda rows, size: labelled_sample(docs, labels, "y", F.col("id") != 2, "doc_id", "text", rows, size).collect()
    whole = take(1000, 1 << 20)
    assert sorted((r.id, r.label) for r in whole if r.text) == sorted([(i, i % 2) for i in range(30) if i != 2] + [(3, 0)])
    assert len(take(10, 1 << 20)) == 10 and sum(len(r.text) for r in take(1000, 950)) == 900


def test_a_labelled_text_over_the_bound_is_passed_over(spark):
    """It comes first by hash, and the others are learned from all the same."""
    from quillspark.llm.common import fitting, labelled_sample

    ids = spark.range(40).select(F.col("id"), F.xxhash64("id").alias("h")).orderBy("h", "id").collect()
    first = ids[0].id
    docs = spark.createDataFrame([(r.id, "y" * 5_000 if r.id == first else "x" * 100) for r in ids], "doc_id long, text string")
    labels = spark.createDataFrame([(r.id, r.id % 2) for r in ids], "doc_id long, y int")
    got = labelled_sample(docs, labels, "y", None, "doc_id", "text", 1000, 4_000).collect()
    assert sorted(r.id for r in got) == sorted(r.id for r in ids if r.id != first)
    assert fitting([9, 3, 5, 2, 2, 1], 8) == [1, 2] and fitting([], 5) == [] and fitting([9], 5) == []


def test_decoding_by_enumeration():
    """The lattice's cheapest path against all of its paths."""
    import itertools

    from quillspark.llm import toxicity as T

    rng = np.random.default_rng(3)
    cost = -np.log(rng.dirichlet(np.ones(T.SYMBOLS) * 0.3, (T.SYMBOLS, T.SYMBOLS)) + 1e-6)
    m = T.Model(cost, {}, 0.1)

    def options(sign, n):
        if sign in T.GAPS:
            return [("", T.GAP_COST), (" ", T.GAP_COST)]
        if sign.isalpha():
            return [(sign * k, T.REPEAT_COST * (n - k)) for k in (1, 2) if k <= n]
        out = [(c * k, T.LOOK_COST * k + T.REPEAT_COST * (n - k)) for c in T.LOOKS.get(sign, "") for k in (1, 2) if k <= n]
        if not out:
            return [("", T.GAP_COST)]
        return out + [("", T.GAP_COST + 1.5)] * (sign in T.PUNCTUATION)

    def total(text, price):
        codes = [0, 0, *(0 if c == " " else int(T.CODE[ord(c)]) if ord(c) < 128 else 28 for c in text), 0]
        return price + sum(cost[a, b, c] for a, b, c in zip(codes, codes[1:], codes[2:], strict=False))

    rand = random.Random(5)
    for _ in range(200):
        token = "".join(rand.choice("abs1!4$.- e3é#") for _ in range(rand.randint(1, 6)))
        runs = [(k, len(list(g))) for k, g in itertools.groupby(token)]
        ways = [("".join(p for p, _ in way), sum(c for _, c in way)) for way in itertools.product(*(options(*r) for r in runs))]
        best = min(total(text, price) for text, price in ways)
        found = m.decode(token)
        assert min(total(text, price) for text, price in ways if text == found) == pytest.approx(best, abs=1e-9)


def test_quality_classifier(spark):
    from quillspark.llm.common import held_out
    from quillspark.llm.quality_classifier import fit, score_quality

    docs, labels = labelled(spark, "quality")
    model = fit(docs, labels, "quality", ~held_out(F.col("id")))
    got = {r.doc_id: r for r in score_quality(docs, model).collect()}
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got.values())
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(got[i].predicted == int(i % 4 != 0) for i in held) >= 0.97 * len(held)
    assert score_quality(docs.limit(0), model).count() == 0
    assert {r.score for r in score_quality(docs, fit(docs, labels.limit(0), "quality")).collect()} == {0.5}


def test_toxicity(spark):
    from quillspark.llm.common import held_out
    from quillspark.llm.toxicity import fit, score_toxicity

    docs, labels = labelled(spark, "toxic")
    model = fit(docs, labels, "toxic", ~held_out(F.col("id")))
    got = {r.doc_id: r for r in score_toxicity(docs, model).collect()}
    assert len(got) == docs.count()
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(got[i].predicted == int(i % 4 == 0) for i in held) >= 0.97 * len(held)
    for plain in ("ba ne tilo", "", "12345 + 67", "soso ruru!!!", "B A N E"):
        assert model.score(plain) < 0.5, plain
    for hidden in ("v1ll41n", "s c o u n d r e l", "WRETCH!", "w-r-e-t-c-h", "vvvillaaain", "$coundrel", "w.r.e.t.c.h"):
        assert model.score(f"ba {hidden} ne") >= 0.5, hidden
    assert score_toxicity(docs.limit(0), model).count() == 0
    assert {r.score for r in score_toxicity(docs, fit(docs, labels.limit(0), "toxic")).collect()} == {0.5}


def test_near_dedup(docs, empty, spark):
    from quillspark.llm.near_dedup import agreement, sketch, with_groups

    got = with_groups(docs).select("row.text", "row.key", "kept").collect()
    assert len(got) == docs.count() and {r.key for r in got} == {"k"}
    empties = [r for r in got if not (r.text or "").strip()]
    assert sum(r.kept for r in empties) == 1 and len(empties) == 3
    assert with_groups(empty).count() == 0
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    texts, group = [], []
    for g in range(30):
        base = [word() for _ in range(rng.randint(100, 600))]
        for _ in range(rng.randint(1, 6)):
            copy = list(base)
            for _ in range(len(base) // 150):  # two copies share over 0.8 of the five-word shingles
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
            group.append(g)
        half = base[: len(base) // 2] + [word() for _ in range(len(base) // 2)]  # about a third in common
        texts.append(" ".join(half))
        group.append(100 + g)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    kept = [group[r.doc_id] for r in with_groups(df).filter("kept").select("row.doc_id").collect()]
    assert set(kept) == set(group)
    assert len(kept) <= 1.05 * len(set(group))
    b = [sketch(t, 5)[1] for t in ("", texts[0], texts[0] + " more")]
    assert agreement(b[0], b[0]) == 1.0 and agreement(b[0], b[1]) == 0.0 and agreement(b[1], b[2]) > 0.9


def test_toxicity_of_one_very_long_token():
    """Decoding takes time in proportion to the token: four times the signs, not sixteen times the seconds."""
    import time

    from quillspark.llm import toxicity as T

    cost = -np.log(np.random.default_rng(3).dirichlet(np.ones(T.SYMBOLS), (T.SYMBOLS, T.SYMBOLS)) + 1e-6)
    m = T.Model(cost, {"=bad": -2.0}, 0.1)
    took = []
    for n in (50_000, 200_000):
        began = time.process_time()
        assert len(m.decode("b4d1!x" * (n // 6))) > n // 3
        took.append(time.process_time() - began)
    assert took[1] < 9 * took[0]
    assert 0 <= m.score("b4d1!x" * 20_000 + " bad") <= 1 and not any(len(t) > T.CACHED for t in m.cache)


def test_toxicity_counts_all_evidence():
    from quillspark.llm.toxicity import Model

    words = ["wretch", "villain", "scoundrel", "rascal", "knave"]
    model = Model(np.zeros((29, 29, 29)), {w: -0.5 for w in words}, 0.1)
    scores = [model.score(" ".join(words[:n])) for n in range(6)]
    assert scores == sorted(set(scores))
    assert abs(scores[5] - (1 - 0.9 * np.exp(-2.5))) < 1e-12


def exact_components(texts, shingle=5, similarity=0.8):
    """The root (least index) of each text's component under exact Jaccard similarity of shingle sets."""
    sets = []
    for t in texts:
        w = t.lower().split()
        sets.append({tuple(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))})
    root = list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= similarity * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return [top(i) for i in range(len(texts))]


def edited(rng, base, edits, word):
    copy = list(base)
    for at in rng.sample(range(5, len(base) - 5), edits):
        copy[at] = word()
    return copy


def passes_slow(line):
    from quillspark.llm.quality_rules import BOILERPLATE

    words = [w for w in SPACE.split(line) if w]
    ink = sum(map(len, words))
    if not ink:
        return True
    symbols, pipes = sum(c in "#*$%&|<>" for c in line), line.count("|")
    if symbols * 10 > ink or (pipes >= 3 and len(words) - pipes <= 3 * (pipes + 1)):
        return False
    extra = sum(len(m[0]) - 1 for m in re.finditer("[!?]+", line))
    stuttered, at = 0, 0
    while at < len(words):
        end = at
        while end < len(words) and words[end] == words[at]:
            end += 1
        stuttered += len(words[at]) * (end - at) * (end - at >= 4)
        at = end
    phrase = len(line) <= 100 and any(b in line.lower() for b in BOILERPLATE)
    return not (extra * 5 > len(words) or phrase or stuttered * 3 > ink)


def test_line_rules_by_brute_force(spark):
    from quillspark.llm.quality_rules import with_quality

    rng = random.Random(8)
    bits = ["word", "Menu", "|", "a", "été", "!!", "wow??", "#", "$%", "Click here", "read more", " ", "\t", "w", "w w w w", "item | item", "long" * 9]
    texts = ["\n".join(" ".join(rng.choice(bits[: rng.randint(2, len(bits))]) for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(1, 8))) for _ in range(600)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    kept = 0
    for r in with_quality(df).collect():
        lines = texts[r.doc_id].split("\n")
        clean = "\n".join(x for x in lines if passes_slow(x))
        ink, left = (len(SPACE.sub("", x)) for x in (texts[r.doc_id], clean))
        assert r.clean_text == clean
        assert r.kept == (not r.base_failed and (ink - left) * 2 <= ink)
        kept += r.kept
    assert 50 < kept < 550


def test_quality_rules_on_very_long_lines(spark):
    from quillspark.llm.quality_rules import with_quality

    rng = random.Random(4)
    stutter = "ha " * 200_000
    mixed = " ".join(f"w{rng.randint(0, 10**9)}" for _ in range(1_000_000))  # one line of 10 MB
    one = "x" * 10_000_000
    df = spark.createDataFrame([(1, stutter), (2, mixed), (3, one), (4, mixed[:2_000_000] + "\n" + stutter)], "doc_id int, text string").repartition(4)
    got = {r.doc_id: r for r in with_quality(df).drop("clean_text").collect()}
    assert not got[1].kept and got[1].lost_percent == 100 and got[1].n_repeat_words == 200_000
    assert got[2].kept and got[2].n_words == 1_000_000
    assert got[3].base_failed and got[3].word_chars == 10_000_000
    assert 0 < got[4].lost_percent < 50


def test_near_dedup_star_of_hundreds(spark):
    """Many edits of one original, each near it and mostly not near each other, with the original anywhere."""
    from quillspark.llm.near_dedup import with_groups

    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base = [word() for _ in range(300)]
    texts = [" ".join(edited(rng, base, 6, word)) for _ in range(700)]
    texts.insert(411, " ".join(base))
    passage = [word() for _ in range(60)]  # held by many texts that are not alike
    texts += [" ".join([word() for _ in range(60)] + passage + [word() for _ in range(30)]) for _ in range(200)]
    root = exact_components(texts)
    assert len(set(root)) == 201
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(3)
    kept = [r.doc_id for r in with_groups(df).filter("kept").select("row.doc_id").collect()]
    assert len(kept) == 201 and {root[i] for i in kept} == set(root)


def test_near_dedup_both_sides_of_the_similarity(spark, monkeypatch):
    """Pairs from 0.7 to 0.9, and keys that many texts without one hub share: kept as exact components say."""
    import quillspark.llm.near_dedup as N

    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    texts = []
    for _ in range(150):
        base = [word() for _ in range(rng.randint(150, 400))]
        texts += [" ".join(base), " ".join(edited(rng, base, max(1, round(len(base) * rng.uniform(0.012, 0.036))), word))]
    base = [word() for _ in range(300)]
    texts += [" ".join(edited(rng, base, 5, word)) for _ in range(120)]  # no original: about 0.72 to 0.85 to each other
    root = exact_components(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(3)
    for crowd, side, size in ((N.CROWD, N.SIDE, N.SIDE_BYTES), (4, 16, 1 << 30), (4, 1000, 20_000)):
        monkeypatch.setattr(N, "CROWD", crowd)
        monkeypatch.setattr(N, "SIDE", side)
        monkeypatch.setattr(N, "SIDE_BYTES", size)
        kept = [r.doc_id for r in N.with_groups(df).filter("kept").select("row.doc_id").collect()]
        assert len(kept) == len(set(root)) and {root[i] for i in kept} == set(root)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as P
    from quillspark.llm.packing import unpack

    rng = random.Random(9)
    prose = lambda n: " ".join("".join(rng.choice(["ba", "ne", "ti", "lo"]) for _ in range(3)) + "." * (rng.random() < 0.1) for _ in range(n))
    shared, base = prose(120), prose(400)
    texts = {1: base, 2: base, 3: prose(300), 4: " ".join(f"{w}&&&" for w in prose(100).split()), 5: None, 6: prose(80) + " " + shared, 7: prose(80) + " " + shared, 8: "tiny"}
    rows = [(i, t, "en", "s", len(t or "")) for i, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    left = {}
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        left[name] = {r.doc_id: r.text for r in docs.collect()}
    assert set(left["quality_rules"]) == {1, 2, 3, 6, 7}
    assert set(left["exact_dedup"]) == set(left["simhash_near_dedup"]) == {1, 3, 6, 7}
    final = left["suffix_array_dedup"]
    assert final[1] == base and final[3] == texts[3] and shared not in final[6] and shared not in final[7]
    packed = P.run(spark, str(tmp_path))
    assert {r.doc_id for r in packed.collect()} == {1, 3, 6, 7}
    assert {r.doc_id: r.text for r in unpack(packed).collect()} == final  # the sequences hold the cleaned texts
    room = [sorted((r.offset, r.length, len(r.ids)) for r in packed.collect() if r.sequence_id == k) for k in {r.sequence_id for r in packed.collect()}]
    assert all(n == m and at == sum(x[1] for x in row[:i]) for row in room for i, (at, n, m) in enumerate(row))
    assert [n for n, _ in P.STAGES] == [*left, "packing"]


def test_pipeline_edges(spark, tmp_path):
    """Nulls in any column, repeated rows, clashing names, an empty table: every stage has its defined result."""
    import corpus_pipeline as P

    rng = random.Random(19)
    word = lambda: "".join(rng.choice(["ba", "ne", "ti", "lo", "ru"]) for _ in range(3))
    prose = lambda n: " ".join(word() for _ in range(n)) + "."
    base, passage = prose(200), prose(60)
    ddl = "doc_id long, text string, lang string, source string, n_chars long, row string, kept int, tag int, fp int, key int, h1 int"
    extra = ("r", 1, 2, 3, 4, 5)
    rows = [(1, base), (1, base), (None, base), (2, None), (3, ""), (4, prose(150) + "\n" + passage + "\n" + prose(90)), (5, prose(150) + "\n" + passage + "\n" + prose(90)), (None, prose(120))]
    rows = [(i, t, None, None if i == 4 else "s", None if t is None else len(t), *extra) for i, t in rows]
    for name, data in (("some", rows), ("none", [])):
        here = f"{tmp_path}/{name}"
        spark.createDataFrame(data, ddl).write.parquet(f"{here}/documents.parquet")
        docs, left = spark.read.parquet(f"{here}/documents.parquet"), {}
        for stage, function in P.STAGES[:-1]:
            out = function(spark, docs, here)
            assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
            out.write.parquet(f"{here}/{stage}")
            docs = spark.read.parquet(f"{here}/{stage}")
            left[stage] = docs.collect()
        packed = P.run(spark, here)
        assert packed.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
        if not data:
            assert packed.count() == 0 and not any(left.values())
            continue
        ids = {k: sorted((r.doc_id is None, r.doc_id or 0) for r in v) for k, v in left.items()}
        assert ids["quality_rules"] == [(False, 1), (False, 1), (False, 4), (False, 5), (True, 0), (True, 0)]
        assert ids["exact_dedup"] == ids["simhash_near_dedup"] == ids["suffix_array_dedup"] == [(False, 1), (False, 4), (False, 5), (True, 0)]
        final = {r.doc_id: r for r in left["suffix_array_dedup"]}
        assert passage not in final[4].text and passage not in final[5].text and final[1].text == base
        assert all(r.n_chars == len(r.text) and (r.row, r.kept, r.h1) == ("r", 1, 5) for r in final.values())
        assert {r.doc_id for r in packed.collect()} == {1, 4, 5, None}


def test_shared_folder_is_needed_on_a_cluster():
    from types import SimpleNamespace as Fake

    from quillspark.llm.common import shared_dir

    unset = Fake(getCheckpointDir=lambda: Fake(isDefined=lambda: False))
    cluster = lambda path: Fake(conf=Fake(get=lambda *_: path), sparkContext=Fake(master="spark://x:7077", _jsc=Fake(sc=lambda: unset)))
    with pytest.raises(ValueError, match="checkpoint"):
        shared_dir(cluster(None))
    assert shared_dir(cluster("hdfs://a/b/")) == "hdfs://a/b"


def test_toxicity_of_beginnings_said_again():
    """A beginning that clean texts say once, and only toxic ones twice, counts from the second time on."""
    from quillspark.llm import toxicity as T

    toxic = [(f"w{k}x gleichung und gleichheit", 1) for k in range(60)]
    clean = [(f"w{k}y gleichung und mehr", 0) for k in range(60)] + [(f"w{k}z etwas ganz anderes", 0) for k in range(400)]
    evidence, base = T.learn_evidence(toxic + clean)
    assert T.repeated("gleich", 2) in evidence and T.repeated("gleich", 3) not in evidence
    assert not {"gleich", "gleichung", "=gleichung"} & set(evidence)
    model = T.Model(np.ones((T.SYMBOLS,) * 3), {p: w for p, w in evidence.items() if p[1:2] == " "}, 0.0)
    assert model.score("gleichung") == 0 and model.score("") == 0
    assert model.score("gleichlos (gleichung)") > 0.9
    assert model.score("gleichlos gleichlos") == model.score("gleichlos gleichlos gleichlos") > 0.9
    assert model.score("gl3ichung gleichung") > 0.9  # restored, then counted
    import pickle

    assert pickle.loads(pickle.dumps(model)).score("gleichung gleichung") > 0.9


def test_pipeline_links_fingerprints(spark):
    """Texts within two bits, by op7's fingerprints, that share few five-word shingles: one of each component stays."""
    import corpus_pipeline as P
    from quillspark.llm.simhash import fingerprint

    rng = random.Random(23)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    texts = [" ".join([f"{c} b{c} c{c}"] * 60 + [word() for _ in range(4)]) for c in "xyz" for _ in range(3)]
    texts += [" ".join(word() for _ in range(80)) for _ in range(5)]
    prints = [fingerprint(t) for t in texts]
    near = [(i, j) for i in range(len(texts)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2]
    assert sorted(near) == [(3 * g + a, 3 * g + b) for g in range(3) for a, b in ((1, 0), (2, 0), (2, 1))]
    assert len(set(exact_components(texts))) == len(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    assert sorted(r.doc_id for r in P.near_dedup(spark, docs, "").collect()) == [0, 3, 6, 9, 10, 11, 12, 13]
