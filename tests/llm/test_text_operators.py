import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from quillon.llm import automaton, binary, bpe, decontaminate, linedup, losertree, neardup, pii, secrets_scan, substring
from quillon.llm.queries import tokenizer_path

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def shingles(text, k=5):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def sha(x):
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


# -- op1 --------------------------------------------------------------------


@pytest.fixture(scope="module")
def benchmark(spark, texts):
    long = [t for t in texts if t and len(words(t)) > 60]
    items = [(1, " ".join(words(long[0])[5:40])), (2, " ".join(words(long[3])[2:9])), (3, "one two three"), (4, "ONE"), (5, None), (6, "?!"), (7, " ".join(words(long[0])[5:40])), (10, " ".join(words(long[5])[10:24]).upper())]
    return spark.createDataFrame([(*i, "clash") for i in items], "item_id long, text string, w string"), items


def brute_hits(by_id, items):
    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        n = min(13, len(w))
        for j in range(len(w) - n + 1) if n else ():
            windows[tuple(w[j : j + n])].add(str(i))
    out = {}
    for d, t in by_id.items():
        w, hit, found = words(t), set(), set()
        for n in {len(k) for k in windows}:
            for j in range(len(w) - n + 1):
                if tuple(w[j : j + n]) in windows:
                    hit |= set(range(j, j + n))
                    found |= windows[tuple(w[j : j + n])]
        out[d] = (len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit) and 20 * len(hit) >= len(w))
    return out


@pytest.mark.parametrize("most", [200_000, 0])
def test_decontamination(docs, by_id, benchmark, most):
    frame, items = benchmark
    got = {r[0]: tuple(r[1:]) for r in decontaminate.report(docs, frame, most_broadcast=most).collect()}
    want = brute_hits(by_id, items)
    assert got == want
    assert any(v[4] for v in want.values()) and any(not v[1] for v in want.values())


def test_decontamination_edges(spark, docs, by_id, benchmark, empty):
    frame, items = benchmark
    assert decontaminate.report(empty, frame).count() == 0
    none = spark.createDataFrame([], "item_id long, text string")
    assert {r.n_hit for r in decontaminate.report(docs, none).collect()} == {0}
    twice = docs.union(docs)
    assert sorted(map(tuple, decontaminate.report(twice, frame).collect())) == sorted(2 * list(map(tuple, decontaminate.report(docs, frame).collect())))
    kept = decontaminate.keep_clean(docs, frame)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {d for d, v in brute_hits(by_id, items).items() if not v[4]}
    cut = {r.doc_id: r.text for r in decontaminate.without_spans(docs, frame).collect()}
    for d, v in brute_hits(by_id, items).items():
        assert len(words(cut[d])) == v[0] - v[1]
        if not v[1]:
            assert cut[d] == by_id[d]


def test_decontamination_by_shuffle_has_no_null_keys(spark, docs, benchmark):
    """Beyond the broadcast, no probe and no document row is dealt by a null."""
    plan = decontaminate.hits(docs, benchmark[0], most_broadcast=0)
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "seed_salt" in text and "xxhash64(rid" in text
    nameless = docs.unionByName(docs.limit(2).selectExpr("cast(null as long) as doc_id", *docs.columns[1:]))
    rows = decontaminate.report(nameless, benchmark[0], most_broadcast=0).collect()
    assert len(rows) == docs.count() + 2 and sum(r.doc_id is None for r in rows) == 2


def test_pipeline_cuts_what_stays_below_the_share(spark, monkeypatch):
    import corpus_pipeline

    item = " ".join(f"item{i}" for i in range(30))
    far = " ".join(f"word{i}" for i in range(900))
    rows = [(1, f"{far}, {item} {far}"), (2, f"{item} {item} end"), (3, far), (4, None), (3, f"{far} {item} more")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(corpus_pipeline, "table", lambda *_: spark.createDataFrame([(1, item)], "item_id long, text string"))
    got = sorted(map(tuple, corpus_pipeline.contaminated_documents(spark, docs, "").collect()), key=str)
    assert got == sorted([(1, f"{far}, {far}"), (3, far), (4, None), (3, f"{far} more")], key=str)


# -- op2 --------------------------------------------------------------------


def brute_classes(by_id):
    sets = {d: shingles(t) for d, t in by_id.items()}
    root, links = {d: d for d in sets}, Counter()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (find(d), links[d]) for d in ids}


def test_jaccard_join(docs, by_id, empty):
    got = {r.doc_id: (r.class_id, r.n_links) for r in neardup.classes(docs).collect()}
    want = brute_classes(by_id)
    assert got == want
    assert max(v[1] for v in want.values()) > 8
    assert neardup.classes(empty).count() == 0
    kept = neardup.keep_first(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {d for d, v in want.items() if v[0] == d}


def test_jaccard_join_in_blocks(docs, by_id, monkeypatch):
    monkeypatch.setattr(neardup, "BUCKET_BLOCK", 3)
    monkeypatch.setattr(neardup, "COMPONENT_BLOCK", 3)
    monkeypatch.setattr(neardup, "MOST_BROADCAST", 0)
    assert {r.doc_id: (r.class_id, r.n_links) for r in neardup.classes(docs).collect()} == brute_classes(by_id)


def test_posterior_threshold():
    # by sampling: pairs of similarity 0.8 or more are dropped with the stated rarity, distant ones early
    rng = np.random.default_rng(0)
    assert all(neardup.least_matches(n) <= 0.8 * n for n in range(20, 121, 20))
    kept = (rng.random((20000, 120)) < 0.8).cumsum(1)
    dropped = np.zeros(20000, bool)
    for n in range(20, 121, 20):
        dropped |= kept[:, n - 1] < neardup.least_matches(n)
    assert dropped.mean() < 0.01
    assert ((rng.random((20000, 20)) < 0.2).sum(1) >= neardup.least_matches(20)).mean() < 0.05


def test_exact_verification_ways():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(base, 50, False), rng.integers(0, 2**63, rng.integers(0, 12), dtype=np.uint64)])) for _ in range(40)]
    i, j = np.triu_indices(40, 1)
    want = [5 * len(set(a) & set(b)) >= 4 * len(set(a) | set(b)) for a, b in ((sets[x].tolist(), sets[y].tolist()) for x, y in zip(i, j))]
    assert neardup.verified(sets, i, j).tolist() == want
    assert [neardup.verified(sets, np.array([x]), np.array([y]))[0] for x, y in zip(i[:60], j[:60])] == want[:60]


# -- op3 --------------------------------------------------------------------

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_spans(t):
    t = t or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24])


def test_secrets(spark, empty):
    import random

    r = random.Random(3)
    bits = ["password", "Secret", "TOKEN", "api_key", "apikey", "api", "=", ":", " ", "  ", '"', "'", "a", "deadbeef", "0123456789abcdef", "AKIA", "ABCDEFGH12345678", "é", "日", "\n", "-", ".", "toke"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 40))) for _ in range(1500)] + [None, "", "0" * 5000 + "password=" + "x" * 9000, "token=a:secret", "secret=token:abcdefg"]
    texts += ["ghp_" + "a1B2" * 9, "AIza" + "x" * 35, "-----BEGIN RSA PRIVATE KEY-----", "xoxb-1234567890-abc"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kinds = ["assign", "access", "hex"]
    rows = {x.doc_id: x for x in secrets_scan.digests(frame).collect()}
    for i, t in enumerate(texts):
        want = base_spans(t)
        got = rows[i]
        assert (got.n_assign, got.n_access, got.n_hex) == tuple(sum(k == n for _, k, _ in want) for n in range(3)), t
        assert got.base_sha256 == sha(",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in want))
    assert [rows[len(texts) - i].spans.split(":")[0] for i in (4, 3, 2, 1)] == ["forge", "cloud", "pem", "chat"]
    assert secrets_scan.digests(empty).count() == 0


def test_automaton_is_minimal_and_right():
    d = automaton.combined([(b"ab|cb", False), (b"b{2,3}", False)])
    for text in (b"abb", b"cbbb", b"xxab", b"bbbb"):
        state, seen = 0, []
        for i, b in enumerate(text):
            state = d.next[state, b]
            seen.append(int(d.accepts[state]))
        want = [sum(bit for bit, p in ((1, rb"(ab|cb)$"), (2, rb"b{2,3}$")) if re.search(p, text[: i + 1])) for i in range(len(text))]
        assert seen == want
    # states that no continuation tells apart are one
    assert len({(int(a), row.tobytes()) for a, row in zip(d.accepts, d.next)}) == len(d.next)


# -- op4 and op10 -----------------------------------------------------------


@pytest.fixture(scope="module")
def reference(by_id):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    t.no_truncation()
    t.no_padding()
    return t, {d: t.encode(x or "", add_special_tokens=False).ids for d, x in by_id.items()}


def test_bpe(docs, by_id, reference, empty):
    t, ids = reference
    got = {r.doc_id: r for r in bpe.round_trip_digests(docs, tokenizer_path()).collect()}
    for d, want in ids.items():
        assert got[d].n_tokens == len(want) and got[d].ids_sha256 == sha(",".join(map(str, want)))
        assert got[d].decoded_sha256 == sha(t.decode(want, skip_special_tokens=False))
    assert bpe.round_trip_digests(empty, tokenizer_path()).count() == 0
    encoded = bpe.encode_documents(docs, tokenizer_path())
    assert {r.doc_id: r.token_ids for r in encoded.collect()} == ids
    assert {r.doc_id: r.decoded for r in bpe.decode_documents(encoded, tokenizer_path()).collect()} == {d: x or "" for d, x in by_id.items()}


def test_bpe_of_random_unicode(reference):
    """Any code points, and what the pre-tokeniser treats apart, against the tokenizers library."""
    import random

    import pyarrow as pa

    r, (t, _) = random.Random(8), reference
    bits = ["the", "Word", "don't", "'s", " ", "  ", "\n", "\t", "\u00a0", "\u2003", "7", "٣", "é", "e\u0301", "日本", "😀", "-", "<|endoftext|>", "<|endo", "ß", "\r\n", "_", "x" * 40]
    texts = ["".join(r.choice(bits) if r.random() < 0.9 else chr(r.choice([r.randrange(1, 0x3000), r.randrange(0xE000, 0x11000), r.randrange(0x1F000, 0x1FFFF)])) for _ in range(r.randint(0, 200))) for _ in range(400)]
    texts += [" ".join(r.choice(["alpha", "beta", "gamma9", "é", "x" * 60]) for _ in range(3000))]
    e = bpe.ChunkEncoder(bpe.codec(tokenizer_path()))
    for text, (_, got) in zip(texts, e.encode_column(pa.array(texts))):
        assert bpe.joined(got).tolist() == t.encode(text, add_special_tokens=False).ids, text
    assert e.repairs == 0


def test_joins_that_disagree_are_encoded_whole(monkeypatch):
    """With edges that aren't certain, agreement with the pieces around a join is what saves the result."""
    import pyarrow as pa

    monkeypatch.setattr(bpe, "_CERTAIN", bpe.re.compile("(?<=[a-z])(?=[a-z])"))
    monkeypatch.setattr(bpe, "last_certain", lambda text: next((i for i in range(len(text) - 1, 0, -1) if text[i - 1].isalpha() and text[i].isalpha()), -1))
    e = bpe.ChunkEncoder(bpe.codec(tokenizer_path()))
    text = "".join(f"someunbrokenletters{chr(97 + i % 26)}" for i in range(400))
    assert list(e.encode_column(pa.array([text]))) and e.repairs > 0


def test_chunks_are_reused():
    import pyarrow as pa

    e = bpe.ChunkEncoder(bpe.codec(tokenizer_path()))
    text = " ".join(f"word{i} and more" for i in range(3000))
    first = [bpe.joined(p).tolist() for _, p in e.encode_column(pa.array([text]))]
    missed = e.misses
    again = [bpe.joined(p).tolist() for _, p in e.encode_column(pa.array(["something else in front " + text]))]
    assert first[0] == e.engine.whole(text).tolist() and again[0] == e.engine.whole("something else in front " + text).tolist()
    assert e.misses - missed < 0.1 * missed


def test_wavelet_shards(spark, docs, by_id, reference, empty, tmp_path):
    _, ids = reference
    path = str(tmp_path / "shards")
    binary.write_shards(docs, tokenizer_path(), path, shard_tokens=3000)
    got = {r.doc_id: r for r in binary.read_documents(spark, path).collect()}
    at = 0
    for d in sorted(ids):
        want = np.array([*ids[d], 2], "<u4")
        assert (got[d].start, got[d].n_tokens, got[d].ids_crc32) == (at, len(want), zlib.crc32(want.tobytes()))
        at += len(want)
    assert spark.read.parquet(path).count() > 4
    every = Counter(x for d in ids for x in [*ids[d], 2])
    common = [x for x, _ in every.most_common(3)] + [49_000]
    assert {r.token_id: r.n for r in binary.count_tokens(spark, path, common).collect()} == {x: every[x] for x in common}
    assert sorted(map(tuple, binary.find_token(spark, path, common[1]).collect())) == sorted((d, i) for d in ids for i, x in enumerate([*ids[d], 2]) if x == common[1])
    assert binary.token_shards(spark, empty, tokenizer_path()).count() == 0


def test_wavelet_matrix():
    rng = np.random.default_rng(5)
    for n, top in ((0, 1), (1, 1), (700, 5), (5000, 50000), (1024, 70000)):
        x = rng.integers(0, top, n).astype(np.uint32)
        m = binary.WaveletMatrix.build(x)
        assert (m.all() == x).all()
        for i in rng.integers(0, n, 20) if n else ():
            s = int(x[i])
            assert m.access(int(i)) == s and m.rank(s, int(i)) == int((x[:i] == s).sum())
            places = np.flatnonzero(x == s)
            assert m.count(s) == len(places) and [m.select(s, k) for k in range(min(4, len(places)))] == places[:4].tolist() and m.select(s, len(places)) == -1
            assert m.select(s, len(places) - 1) == places[-1] and (m.occurrences(s) == places).all()
        assert len(m.occurrences(top + 3)) == m.count(top + 3) == 0


# -- op6 --------------------------------------------------------------------


def test_pseudonyms(spark, docs, by_id, empty):
    p = pii.Pseudonyms(b"key")
    for text, kind in [("+1 (389) 555-5010", "phone"), ("389-555-5010", "phone"), ("4099647182869901", "card"), ("4099 6471 8286 9901", "card"), ("John.Doe77@mail1.example.com", "email"), ("73.209.219.114", "ipv4"), ("123-45-6789", "ssn"), ("1985-03-31", "date"), ("31/03/1985", "date"), ("DE89 3704 0044 0532 0130 00", "iban")]:
        new, found = p.rewrite(f"see {text}, ok")
        assert [f[0] for f in found] == [kind] and new != f"see {text}, ok" and len(new) >= len(text)
        again, more = p.rewrite(new)
        assert [f[0] for f in more] == [kind]  # the pseudonym is valid itself
        assert p.rewrite(new, back=True)[0] == f"see {text}, ok"
        assert pii.Pseudonyms(b"other").rewrite(f"see {text}, ok")[0] != new
    assert p.rewrite("4099647182869902 999.1.1.1 000-12-3456 2020-13-45 version 4.0.1")[1] == []
    assert [p.walk("t", x, 50) for x in range(50)] != list(range(50)) and sorted(p.walk("t", x, 50) for x in range(50)) == list(range(50))
    frame = spark.createDataFrame([(1, "a 73.209.219.114 b"), (2, "c 73.209.219.114"), (3, None), (4, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.pseudonymise(frame, b"key").collect()}
    assert got[1].text.split()[1] == got[2].text.split()[1] != "73.209.219.114" and got[1].n_ipv4 == 1 and got[1].spans == "ipv4:2:16"
    assert got[3].text is None and got[4].text == "" and got[3].spans == ""
    assert pii.pseudonymise(empty, b"key").count() == 0
    assert {r.doc_id: r.text for r in pii.pseudonymise(pii.pseudonymise(docs, b"key"), b"key", back=True).collect()} == by_id


def test_phones_outside_the_number_plan():
    p = pii.Pseudonyms(b"key")
    for phone, rest in [("+1 (017) 555-7713", ""), ("+1 (132) 555-1352", ""), ("+15551234567", ""), ("+442071234567", ""), ("+1 (826) 555-4081", " 190.137.20.5"), ("+1 (017) 555-7713", " 190.137.20.5")]:
        text = f"call {phone}{rest}, ok"
        new, found = p.rewrite(text)
        assert [f[0] for f in found] == ["phone", "ipv4"][: 1 + bool(rest)] and found[0][1:] == (5, 5 + len(phone))
        assert phone not in new and (not rest or rest not in new)
        assert [f[0] for f in p.rewrite(new)[1]] == [f[0] for f in found] and p.rewrite(new, back=True)[0] == text
    assert p.rewrite("017-555-7713 or +12345678.5")[1] == []
    some = [f"+1 ({x:03d}) 555-7713" for x in range(0, 1000, 7)]
    assert len({p.rewrite(x)[0] for x in some}) == len(some)


def planted(r):
    """A random value with its kind, or None where it isn't one; made without the operator's rules."""
    import datetime
    import ipaddress

    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    kind = r.choice(["email", "card", "ssn", "ipv4", "ipv6", "phone", "date", "none"])
    if kind == "email":
        return kind, f"{r.choice(['ana', 'Bo.b', 'x_9', 'a+tag'])}{r.randrange(99)}@{r.choice(['mail', 'a-b', 'bücher', 'почта'])}.{r.choice(['com', 'co.uk', 'example', 'рф'])}"
    if kind == "card":
        body = r.choice("3456") + d(r.choice([13, 14, 15]))
        check = next(c for c in "0123456789" if sum(int(x) if i % 2 == 0 else sum(divmod(int(x) * 2, 10)) for i, x in enumerate((body + c)[::-1])) % 10 == 0)
        return kind, body + check
    if kind == "ssn":
        return kind, f"{r.randrange(1, 666):03d}-{r.randrange(1, 100):02d}-{r.randrange(1, 10000):04d}"
    if kind == "ipv4":
        return kind, str(ipaddress.IPv4Address(r.randrange(0x0B000000, 0x7F000000)))
    if kind == "ipv6":
        a = ipaddress.IPv6Address(0x20 << 120 | r.getrandbits(120) & ~(0xFFFF << 48))
        return kind, r.choice([str(a), a.exploded, str(a).upper() if any(c.isalpha() for c in str(a)[4:]) else str(a)])
    if kind == "phone":
        return kind, r.choice([f"+44{r.randrange(10**9, 10**10)}", f"+1 ({r.randrange(200, 999)}) {r.randrange(200, 999)}-{d(4)}", f"020 {r.randrange(1000, 9999)} {d(4)}", f"06 {d(2)} {d(2)} {d(2)} {d(2)}", f"{r.randrange(200, 999)}-{r.randrange(200, 999)}-{d(4)}"])
    if kind == "date":
        day = datetime.date(1900, 1, 1) + datetime.timedelta(days=r.randrange(73000))
        return kind, r.choice([day.isoformat(), day.strftime("%Y/%m/%d"), day.strftime("%d/%m/%Y"), day.strftime("%d.%m.%Y"), f"{day.day} {day:%B} {day.year}", f"{day:%b} {day.day}, {day.year}", f"{day:%B} {day:%d} {day.year}", f"{day.day} {day:%b} {day.year}".upper()])
    return None, r.choice(["2020-13-45", "31 April 1985", "12:30:45", "4099647182869902", "version 4.0.1", "999.1.1.1", "2001:zz::1", "001 234", "0000 0000 00", "mayor 3, 1990", "12 34", "v2001:db8"])


def test_personal_data_against_what_was_planted():
    import random

    r, p = random.Random(17), pii.Pseudonyms(b"key")
    for _ in range(400):
        values = [planted(r) for _ in range(6)]
        text, want = "", []
        for kind, value in values:
            text += r.choice(["see ", "voici: ", "\n(", "日本 ", "it is "])
            if kind:
                want.append((kind, len(text), len(text) + len(value)))
            text += value + r.choice([", and", "; ok", " done", ")\n"])
        new, found = p.rewrite(text)
        assert found == want, text
        assert all(v not in new for k, v in values if k and len(v) > 8)
        again = p.rewrite(new)[1]
        assert [f[0] for f in again] == [f[0] for f in want], (text, new)
        assert p.rewrite(new, back=True)[0] == text


# -- op7 --------------------------------------------------------------------


def brute_repeats(by_id):
    seen, out = set(), {}
    for d in sorted(by_id):
        raw = (by_id[d] or "").encode()
        gone = bytearray(len(raw))
        for q in range(len(raw) - 99):
            x = raw[q : q + 100]
            if x in seen:
                gone[q : q + 100] = b"\1" * 100
            seen.add(x)
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out[d] = (len(raw), sum(gone), sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone)), sha(kept))
    return out


@pytest.mark.parametrize("hot", [2000, 1])
def test_substrings(docs, by_id, hot, monkeypatch):
    monkeypatch.setattr(substring, "HOT", hot)
    got = {r[0]: tuple(r[1:]) for r in substring.report(docs).collect()}
    want = brute_repeats(by_id)
    assert got == want
    assert sum(v[1] for v in want.values()) > 10_000


def test_substring_edges(docs, by_id, empty):
    assert substring.report(empty).count() == 0
    cut = substring.dedup(docs)
    assert cut.columns == docs.columns
    want = brute_repeats(by_id)
    for r in cut.collect():
        assert (r.text is None) == (by_id[r.doc_id] is None)
        size, gone = want[r.doc_id][:2]
        assert size - gone - 8 * want[r.doc_id][2] <= len((r.text or "").encode()) <= size - gone


def test_loser_tree():
    import random

    r = random.Random(2)
    runs = [sorted(bytes(r.choice(b"ab") for _ in range(r.randint(0, 12))) for _ in range(r.randint(0, 30))) for _ in range(7)]
    coded = [losertree.front_coded(x) for x in runs]
    assert [[s for s, _ in losertree.decoded(*c)] for c in coded] == runs
    at, last, out = [0] * 7, b"", []
    for run, shared in losertree.merged([losertree.decoded(*c) for c in coded]):
        s = runs[run][at[run]]
        at[run] += 1
        assert shared == losertree.common(last, s, 0) or not out
        out.append(s)
        last = s
    assert out == sorted(s for x in runs for s in x)
    assert list(losertree.merged([])) == []


# -- op8 --------------------------------------------------------------------


def word_tokens(line):
    seen = Counter()
    return {(w, seen.update([w]) or seen[w]) for w in words(line)}


def brute_lines(by_id, shingles=shingles):
    kept, sets = {}, []
    for d in sorted(by_id):
        n, stay = 0, []
        for k, line in enumerate((by_id[d] or "").split("\n")):
            s = shingles(line)
            if not s:
                continue
            n += 1
            if not any(5 * len(s & o) >= 4 * len(s | o) for o in sets):
                stay.append(k)
            sets.append(s)
        kept[d] = (n, n - len(stay), ",".join(map(str, stay)))
    return kept


@pytest.mark.parametrize("block", [512, 2])
def test_lines(docs, by_id, empty, block, monkeypatch):
    monkeypatch.setattr(linedup, "BLOCK", block)
    got = {r[0]: tuple(r[1:]) for r in linedup.report(docs).collect()}
    want = brute_lines(by_id)
    assert got == want and sum(v[1] for v in want.values()) > 50
    if block == 2:
        assert linedup.report(empty).count() == 0


def test_lines_with_words_as_tokens(spark, docs, by_id):
    got = {r[0]: tuple(r[1:]) for r in linedup.report(docs, shingle=1).collect()}
    assert got == brute_lines(by_id, word_tokens)
    near = spark.createDataFrame([(1, "one two three four five six seven eight nine ten"), (2, "one two three four FIVE! other seven eight nine ten"), (3, "to be or not to be"), (4, "to be or not be to to")], "doc_id long, text string")
    assert [r.n_removed for r in linedup.report(near, shingle=1).orderBy("doc_id").collect()] == [0, 1, 0, 1]
    assert sum(r.n_removed for r in linedup.report(near).collect()) == 0


def test_line_dedup_rewrites(docs, by_id):
    want = brute_lines(by_id)
    got = {r.doc_id: r.text for r in linedup.dedup(docs).collect()}
    for d, (n, gone, kept) in want.items():
        if n and n == gone:
            assert d not in got
        else:
            lines = (by_id[d] or "").split("\n")
            stay = set(map(int, kept.split(","))) if kept else set()
            left = [x for k, x in enumerate(lines) if k in stay or not words(x)]
            assert got[d] == by_id[d] if not gone else [x for x in got[d].split("\n") if words(x)] == [x for x in left if words(x)]


def test_lines_with_rare_and_frequent_tokens(spark, monkeypatch):
    """Levels on both sides of 32: tokens of half the unsigned range and more are negative as Spark's longs."""
    monkeypatch.setattr(linedup, "levels", lambda counts: np.where(np.arange(len(counts)) % 10 == 0, 20, 40).astype(np.uint8))
    r, rows = np.random.default_rng(5), []
    for i in range(60):  # a changed word of 54 leaves 45 of 55 shingles in common
        line = [f"w{x}" for x in r.integers(10**6, size=54)]
        rows += [(i, " ".join(line)), (1000 + i, " ".join([*line[:27], "changed", *line[28:]]))]
    got = {x[0]: tuple(x[1:]) for x in linedup.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute_lines(dict(rows))
    assert got == want and sum(v[1] for v in want.values()) == 60
