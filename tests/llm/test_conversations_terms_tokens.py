"""Source divergence, conversation repair and token counts against plain versions."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from conftest import differences
from pyspark.sql import functions as F

from quoin.llm import conversations, divergence, queries, tokens

WORD = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


# Source divergence


def plain_divergence(docs, least=10, top=10):
    """Every term for every pair, in Python's whole numbers."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    count, files, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in ((a or "", b or "", (c or "").translate(lower)) for a, b, c in docs):
        groups[lang].add(source)
        found = WORD.findall(text)
        count[lang, source].update(found)
        files[lang].update(set(found))
    out = []
    f = lambda p, q: (p - q) ** 2 // (p + q)
    for lang, sources in groups.items():
        kept = [t for t, n in files[lang].items() if n >= least]
        share = {}
        total = Counter()
        for s in sources:
            total.update({t: count[lang, s][t] for t in kept})
        for s, c in [*((s, count[lang, s]) for s in sources), (None, total)]:
            n = sum(c[t] for t in kept)
            share[s] = {t: 1 + 10**9 * (c[t] + 2) // (n + 2 * len(kept)) for t in kept}
        for s in sources:
            pair = [(sum(f(share[s][t], share[o][t]) for t in kept), o) for o in sources if o != s]
            term = [(f(share[s][t], share[None][t]), t) for t in kept if count[lang, s][t] and share[s][t] > share[None][t]]
            for part, rows, limit in (("pair", pair, None), ("term", term, top)):
                out += [(lang, s, part, item, v, r) for r, (v, item) in enumerate(sorted(rows, key=lambda x: (-x[0], x[1].encode()))[:limit], 1)]
    return sorted(out)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def texts(rng, n, sources, words):
    for _ in range(n):
        common = [rng.choice(words[:40]) for _ in range(rng.randint(0, 30))]
        yield rng.choice(["en", "xx", None]), rng.choice(sources), " ".join(common + [rng.choice(words) for _ in range(rng.randint(0, 20))])


def test_divergence(spark):
    rng = random.Random(3)
    words = [f"{rng.choice(['Ab', 'é', 'zß', 'Q', '漢'])}{''.join(rng.choice('abcde') for _ in range(k % 3 + 1))}" for k in range(300)]
    docs = [*texts(rng, 900, [f"s{i}" for i in range(24)] + [None, ""], words), ("en", "silent", None), ("en", "silent2", "12 34 !!"), ("lone", "one", "a b"), ("none", "x", ""), ("none", "y", "rare words")]
    docs += [docs[3]] * 15
    table = spark.createDataFrame(docs, "lang string, source string, text string").withColumn("term", F.lit(1)).withColumn("p", F.lit("x")).withColumn("of", F.lit(0))
    for least, top in ((10, 10), (1, 3)):
        assert rows(divergence.audit(table, least, top)) == sorted(plain_divergence(docs, least, top), key=str)
    assert rows(divergence.audit(table.limit(0))) == []


def test_divergence_many_sources(spark):
    """More sources than a tile is wide, so that pairs come from tiles off the diagonal too."""
    rng = random.Random(5)
    docs = [(lang or "en", s, t) for s in (f"s{i:03}" for i in range(270)) for lang, _, t in texts(rng, 2, ["x"], [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(90)])]
    table = spark.createDataFrame(docs, "lang string, source string, text string")
    assert rows(divergence.audit(table, 3)) == sorted(plain_divergence(docs, 3), key=str)


def test_large_counts(spark):
    """Shares stay exact where counts times the scale leave 64 bits."""
    n, total, terms = 13 * 10**15 + 7, 9 * 10**17 + 11, 10**8 + 1
    got = spark.createDataFrame([(n, total, terms), (0, 0, 0)], "n long, total long, terms long").select(divergence.share("n", "total", "terms").alias("p")).collect()
    assert [r.p for r in got] == [1 + 10**9 * (n + 2) // (total + 2 * terms), 1]


# Conversations


def plain_damage(turns):
    for conv, turn, role, text in turns:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        for _ in range(0 if kind == 0 else 2 if kind == 3 else 1):
            yield conv, turn, "user" if kind == 4 else role, text


def cheapest(found):
    """(cost, audit) by visiting edits in order of cost and initials."""
    after = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
    todo, seen = [(0, "", 0, 0)], set()
    while todo:
        cost, audit, i, state = heapq.heappop(todo)
        if (i, state) in seen:
            continue
        if i == len(found) and state in (0, 3):
            return cost, audit
        seen.add((i, state))
        given = after[state]["a" if state == 2 else "u"]
        heapq.heappush(todo, (cost + 3, audit + "I", i, given))
        if i < len(found):
            fault, initial = found[i]
            heapq.heappush(todo, (cost + 4, audit + "D", i + 1, state))
            if fault in ("", "truncated"):
                more = 3 * (fault == "truncated")
                if initial in after[state]:
                    heapq.heappush(todo, (cost + more, audit + "K", i + 1, after[state][initial]))
                heapq.heappush(todo, (cost + more + 3, audit + "R", i + 1, given))


def plain_repair(all_convs, turns):
    by = {c: [] for c in all_convs}
    for conv, turn, role, text in turns:
        by[conv].append((turn is not None, turn or 0, role, text))
    out, kept = [], []
    for conv, found in by.items():
        found.sort()
        seen, faults = set(), []
        for _, _, role, text in found:
            bare = re.sub("[\x20\x09-\x0d]", "", text)
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        initials = [r[:1] for _, _, r, _ in found]
        cost, audit = cheapest(list(zip(faults, initials, strict=True)))
        lines, at, last = [], 0, ""
        for edit in audit:
            role = {"u": "assistant"}.get(last, "user")
            if edit == "K":
                role = found[at][2]
            if edit != "D":
                lines.append((edit, role, "" if edit == "I" else found[at][3]))
                last = role[:1]
            at += edit != "I"
        known = {t for there, t, _, _ in found if there}
        gaps = max(known) - min(known) + 1 - len(known) if known else 0
        text = "\n".join(f"{r}:{t}" for _, r, t in lines)
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        out.append((conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
        kept += [(conv, n, *line) for n, line in enumerate(lines, 1)]
        assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for _, r, _ in lines))
    return sorted(out, key=str), sorted(kept, key=str)


def conversation_rows():
    rng = random.Random(11)
    out = []
    for conv in [*range(150), None]:
        for turn in range(rng.choice([1, 2, 4, 7, 15])):
            role = rng.choice(["user", "assistant"] * 4 + ["system", "tool", None, "", "sue"]) if rng.random() < 0.3 else ["user", "assistant"][turn % 2]
            text = rng.choice(["Fine.", "Why?", "No end", "", " \t", None, "Really!\n", "x ", "y. \x0b", "z\x85", "a. ", "é!"])
            out.append((conv, rng.choice([turn, turn, turn, turn + 3, 2, None]), role, text))
    return out + out[:9] + [(900, t, "user" if t % 3 else "assistant", f"{t % 50}.") for t in range(700)]


def test_repair(spark):
    turns = conversation_rows()
    table = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    told, kept = plain_repair(dict.fromkeys(r[0] for r in turns), list(plain_damage(turns)))
    damaged = conversations.damage(table)
    assert rows(conversations.reports(damaged, live="live")) == told
    assert rows(conversations.repaired(damaged, live="live")) == kept
    whole = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in turns]
    extra = table.withColumns({c: F.lit("?") for c in ("live", "conv", "place", "sweep", "code", "copy", "bare")})
    assert rows(conversations.reports(extra)) == plain_repair(dict.fromkeys(r[0] for r in turns), whole)[0]
    assert rows(conversations.reports(table.limit(0))) == []


def test_all_rows_dropped(spark):
    gone = [(c, 0) for c in range(400) if zlib.crc32(f"{c}:0".encode()) % 20 == 0][:2]
    table = spark.createDataFrame([(c, t, "user", "x.") for c, t in gone], "conv_id long, turn long, role string, text string")
    none = hashlib.sha256(b"").hexdigest()
    assert rows(conversations.reports(conversations.damage(table), live="live")) == [(c, 0, 0, 0, 0, 0, 0, "", none) for c, _ in gone]


def test_named_columns(spark):
    table = spark.createDataFrame([("k", 1, "user", "Hi."), ("k", 2, "user", "Ho.")], "thread string, n int, who string, said string")
    got = conversations.repaired(table, "thread", "n", "who", "said")
    assert rows(got) == [("k", 1, "K", "user", "Hi."), ("k", 2, "R", "assistant", "Ho.")]


def test_given_conversations(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    turns = [(r.conv_id, r.turn, r.role, r.text) for r in table.collect()]
    assert rows(queries.op12_conversation_repair(spark, sf_dir)) == plain_repair(dict.fromkeys(r[0] for r in turns), list(plain_damage(turns)))[0]


# Tokens


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def awkward_texts():
    rng = random.Random(2)
    letters = "  \n\t▁aeinrstéßñ漢字🙂.,<>/s\x00'0129"
    made = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    return [None, "", " ", "  ", "▁", "▁▁ a", "<s> </s> <unk> <0x0A>", "a" * 5000, "the " * 3000, "漢" * 900, "x\n\n  y \t z ", *made, "The quick brown fox\njumps over it. " * 40] + ["same"] * 3


def test_tokens(spark, library):
    docs = [(i, t) for i, t in enumerate(awkward_texts())]
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n_tokens", F.lit("clash"))
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in tokens.count_tokens(table, limit=100).collect()}
    for i, t in docs:
        n = len(library.encode(t or ""))
        assert got[i] == (len((t or "").encode()), n, n > 100), t
    assert tokens.count_tokens(table.limit(0)).collect() == []


def test_given_tokens(spark, sf_dir, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = queries.op13_token_counts(spark, sf_dir).collect()
    assert len(got) == len(texts)
    assert all(r.n_tokens == len(library.encode(texts[r.doc_id] or "")) and r.over_limit == (r.n_tokens > 4096) for r in got)


def test_proof(library):
    """Every string called one token is, and every piece that may start a pre-token and is one token is found."""
    shortcut = tokens.Shortcut(tokens.read_model())
    assert shortcut.cuts
    for i in range(library.get_piece_size()):
        piece = library.id_to_piece(i)
        if piece.startswith("▁") and piece != "▁" and not library.is_control(i) and "▁" not in piece.lstrip("▁"):
            assert (piece in shortcut.single) == (len(library.encode(tokens.as_text(piece))) == 1)
    assert not any(library.is_byte(library.piece_to_id(p)) for p in shortcut.single)


def test_without_cut(library):
    shortcut = tokens.Shortcut(tokens.read_model())
    shortcut.cuts = False
    texts = awkward_texts()
    assert tokens.Counting(shortcut).count(texts) == [len(library.encode(t or "")) for t in texts]


def test_memory_is_bounded(library, monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 5)
    counting = tokens.Counting(tokens.Shortcut(tokens.read_model()))
    for t in awkward_texts():
        assert counting.count([t]) == [len(library.encode(t or ""))]


def test_divergence_sql(spark, sf_dir, duck):
    assert differences(queries.op11_source_divergence(spark, sf_dir).toPandas(), duck.sql(queries.ORACLES["op11_source_divergence"]).df()) == []
