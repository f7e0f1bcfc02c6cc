"""Spelling variants, conversation repair and line dedup against brute force."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from kervan.llm import conversation_repair as R
from kervan.llm import spelling_variants as V
from kervan.llm.line_dedup import dedup_lines

SPACE = " \t\n\x0b\x0c\r"


def lower_az(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


# Spelling variants


def words_brute(docs, every=31):
    n = {}
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = lower_az(run)
            h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
            if every and h % every == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            n[word] = n.get(word, 0) + 1
    return {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def variants_brute(n, ratio=10):
    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    best = {w: min(x, key=lambda v: (-n[v], v)) for w, x in near.items() if x}
    form = {w: b for w, b in best.items() if n[b] >= ratio * n[w]}
    rows = set()
    for w in n:
        root = w
        while root in form:
            root = form[root]
        rows.add((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return rows


@pytest.mark.parametrize("block_words", [2, 5, 4096])
def test_variants(spark, block_words):
    rng = random.Random(7)
    base = ["".join(rng.choice("abcé") for _ in range(rng.randint(7, 11))) for _ in range(40)]
    words = set(base)
    for w in base:
        for _ in range(8):
            k = rng.randrange(len(w) + 1)
            words.add(rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice("abcéÿ") + w[k:], w[:k] + "z" + w[k + 1 :]]))
    n = {w: rng.choice([1, 2, 3, 30, 400, 5000]) for w in words if len(w) >= 7}
    n["a" * 40_000] = n["a" * 40_001] = 3
    got = V.variant_groups(spark.createDataFrame(list(n.items()), "word string, n bigint"), block_words=block_words)
    assert {tuple(r) for r in got.select("word", "form", "root", "n", "n_near", "form_n").collect()} == variants_brute(n)


def test_corpus_words(spark):
    rng = random.Random(3)
    pool = ["".join(rng.choice("abTHéÀß÷") for _ in range(rng.randint(5, 9))) for _ in range(60)]
    docs = [(i if i % 7 else None, " ".join(rng.choices(pool, k=60))) for i in range(40)] + [(1, None), (2, ""), (3, pool[0] * 3000 + "-" + pool[0] * 3000)]
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id bigint, text string, word string, n int")
    got = {(r["word"], r["n"]) for r in V.corpus_words(frame).collect()}
    assert got == set(words_brute(docs).items())
    assert V.variant_groups(V.corpus_words(frame.filter("false"))).count() == 0


# Conversation repair

LEGAL = re.compile("(s?(ua)+)?")


def damage_brute(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if h == 0:
            continue
        if h == 1:
            text = ""
        elif h == 2:
            text = re.sub("[.!?]", "", text)
        elif h == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if h == 3 else 1)
    return out


def faults_brute(rows):
    seen, faults = set(), []
    for _, _, role, text in rows:
        bare = text.rstrip(SPACE)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
    return faults


def repair_brute(rows, faults):
    """Every way to edit, by cost and audit."""
    best = None
    gaps = [(), ("user",), ("assistant",), ("user", "assistant"), ("assistant", "user")]

    def extend(k, cost, audit, lines):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        for extra in gaps:
            c, a, x = cost + 5 * len(extra), audit + "I" * len(extra), lines + [(r, "") for r in extra]
            if k == len(rows):
                if LEGAL.fullmatch("".join(r[:1] or "-" for r, _ in x)) and (best is None or (c, a) < best[:2]):
                    best = (c, a, x)
                continue
            _, _, role, text = rows[k]
            extend(k + 1, c + 2, a + "D", x)
            if faults[k] not in ("blank", "duplicate"):
                cut = 5 if faults[k] == "truncated" else 0
                extend(k + 1, c + cut, a + "K", x + [(role, text)])
                for other in ("user", "assistant"):
                    extend(k + 1, c + 1 + cut, a + "R", x + [(other, text)])

    extend(0, 0, "", [])
    return best


def summary_brute(rows):
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).hexdigest()))
    faults = faults_brute(rows)
    turns = {r[1] for r in rows if r[1] is not None}
    cost, audit, lines = repair_brute(rows, faults) if rows else (0, "", [])
    initials = [r[2][:1] for r in rows]
    return (
        max(turns) - min(turns) + 1 - len(turns) if turns else 0,
        *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
        sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
        cost,
        audit,
        hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest(),
    )


def random_conversations(n, rng):
    texts = ["One.", "Two!", "Three", "  ", "", None, "Four?\n", "One. ", "Ünf."]
    rows = []
    for conv in range(n):
        for turn in range(rng.randint(1, 4)):
            role = rng.choice(["system", "user", "assistant", "user", "assistant", None, "", "tool"])
            rows.append((conv if conv else None, rng.choice([turn, turn, turn, None, 3, turn + 5]), role, rng.choice(texts)))
    gone = next(c for c in range(n, n + 1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    return [*rows, (gone, 0, "user", "All dropped.")]


@pytest.mark.parametrize("chunk", [1, 2, 256])
def test_repair(spark, monkeypatch, chunk):
    monkeypatch.setattr(R, "CHUNK", chunk)
    rows = random_conversations(150, random.Random(chunk))
    frame = spark.createDataFrame([(*r, 5, "m") for r in rows], "conv_id bigint, turn bigint, role string, text string, cost int, moves string")
    got = {r["conv_id"]: tuple(r)[1:] for r in R.repair_report(frame, R.damaged(frame)).collect()}
    want = {}
    for conv in {r[0] for r in rows}:
        want[conv] = summary_brute(damage_brute([r for r in rows if r[0] == conv]))
    assert got == want
    assert sum(1 for x in want.values() if x[6] == "") > 0 and any("R" in x[6] for x in want.values())


def test_repair_of_long_conversations(spark):
    """Chunks change nothing: 2 000 rows in chunks of 256 cost what one run of the whole string costs."""
    rng = random.Random(1)
    rows = [(9, k, rng.choice(["user", "assistant", "tool"]), f"Text {k}{rng.choice(['.', ''])}") for k in range(2_000)]
    summaries, repaired = R.repair(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))
    letters = "".join(({"t": "x"}.get(r[2][0], r[2][0])).upper() if r[3][-1] != "." else {"t": "x"}.get(r[2][0], r[2][0]) for r in rows)
    costs, ranks, moves = R.solve_chunk(letters)
    cost, _, audit = min((costs[e] + extra, ranks[e], moves[e] + tail) for e, (extra, tail) in enumerate([(0, ""), (10, "UA"), (5, "A"), (0, "")]) if costs[e] >= 0)
    row = summaries.first()
    assert (row["cost"], row["audit"]) == (cost, audit.translate(str.maketrans("UAua", "IIRR")))
    roles = [r["role"][0] for r in repaired.orderBy("seq").collect()]
    assert LEGAL.fullmatch("".join(roles))
    empty = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert R.repair_report(empty, R.damaged(empty)).count() == 0


# Line dedup


def lines_brute(docs, min_chars=20, min_docs=3):
    held = {}
    for n, (i, text) in enumerate(docs):
        for line in (text or "").split("\n"):
            key = lower_az(line.strip(SPACE))
            if len(key) >= min_chars:
                held.setdefault(key, {})[n] = i
    keeper = {}
    for key, rows in held.items():
        if len(rows) >= min_docs:
            ids = [i for i in rows.values() if i is not None]
            keeper[key] = max(ids) if ids else None
    out = []
    for i, text in docs:
        lines = (text or "").split("\n")
        keys = [lower_az(x.strip(SPACE)) for x in lines]
        kept = [x for x, k in zip(lines, keys) if k not in keeper or keeper[k] == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("filter_bits", [1 << 13, 1 << 29])
def test_lines(spark, filter_bits):
    rng = random.Random(5)
    shared = [f"Shared line number {k} of a licence" for k in range(30)] + ["éééééééééééééééééééé", "éééééééééé 1234567", "short line"]
    dress = [lambda x: x, str.upper, lambda x: f" \t{x}\r", lambda x: x + "\x0b"]
    docs = []
    for i in range(120):
        lines = [rng.choice(dress)(rng.choice(shared)) for _ in range(rng.randint(0, 12))] + [f"A line of its own in document {i}" for _ in range(rng.randint(0, 2))]
        rng.shuffle(lines)
        docs.append((i if i % 10 else rng.choice([None, 111]), "\n".join(lines)))
    docs += [docs[5]] * 3 + [(200, None), (201, ""), (202, "\n\n"), (None, "Only rows without an id hold it\nx")] * 3
    docs += [(300, "\n".join(["A repeated line of one long document"] * 5_000))]
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id bigint, text string, suspects string, _row int")
    got = sorted((tuple(r) for r in dedup_lines(frame, filter_bits=filter_bits).select("doc_id", "n_lines", "n_dropped", "kept_text").collect()), key=repr)
    assert got == lines_brute(docs)
    assert dedup_lines(frame.filter("false")).count() == 0


def test_one_edit_of_the_brute_force():
    assert one_edit("abc", "abd") and one_edit("abc", "abcd") and not one_edit("abc", "abc") and not one_edit("abc", "acb")
    assert not any(one_edit(a, b) for a, b in itertools.permutations(["abcdefg", "abcdefghi"], 2))
