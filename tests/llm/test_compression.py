import base64
import random
import re

from mixdetect.llm import compression

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    words = WORD.findall(text or "")
    seen = {}
    for i in range(len(words) - 4):
        seen.setdefault(tuple(words[i:i + 5]), []).append(i)
    marked = {j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + 5)}
    lines, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in lines
            lines.add(line)
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(marked), n < 10 or 100 * len(marked) > 20 * n)


def test_measures(frame, prose, clashing):
    rng = random.Random(1)
    p = prose(7)
    texts = [None, "", " \n\t", "a b", "a\n\na\n a\na b\n\n", "x # <y> | é", f"{p} one {p} two {prose(60)}", "w " * 50_000, prose(30_000),
             "\n".join(["same line here"] * 9), prose(200), "\x0b".join("abcdefghijklmno"), " wide space " * 12,
             " ".join(str(rng.random()) for _ in range(7000)) + " " + p + " " + p]
    rows = [(None if k == 3 else k, t) for k, t in enumerate(texts)] + [(0, None)]
    out = compression.score(clashing(frame(rows))).collect()
    got = sorted(str((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)) for r in out)
    assert got == sorted(str((i, *base(t))) for i, t in rows)
    assert all(not (r.base_failed and r.kept) for r in out)


def test_bands(frame, prose):
    rng = random.Random(2)
    noise = " ".join(base64.b64encode(rng.randbytes(9)).decode() for _ in range(400))
    stretched = " ".join(f"{prose(3, seed=1)} {k}" for k in range(800))  # no window twice, yet much the same
    rows = [prose(n) for n in (12, 30, 60, 120, 400, 3000, 20_000)] + [noise, stretched]
    kept = {r.doc_id: r.kept for r in compression.score(frame(rows)).collect()}
    assert [kept[k] for k in range(len(rows))] == [True] * 7 + [False, False]
    left = compression.apply_rules(frame(rows))
    assert sorted(r.doc_id for r in left.collect()) == list(range(7)) and left.columns == frame([]).columns


def noise_words(rng, n, kind):
    word = {"base64": lambda: base64.b64encode(rng.randbytes(9)).decode(),
            "printable": lambda: "".join(chr(rng.randrange(33, 127)) for _ in range(9))}[kind]
    return " ".join(word() for _ in range(n // 10 + 1))[:n]


def test_noise_of_each_short_band(frame, prose):
    rng = random.Random(6)
    sizes = [140, 160, 161, 200, 230, 256, 257, 320, 321, 400, 401, 512, 513, 800, 1024]
    rows = [noise_words(rng, n, kind) for n in sizes for kind in ("base64", "printable")]
    clean = [prose(400).encode()[:n].decode(errors="ignore") for n in sizes]
    out = {r.doc_id: r for r in compression.score(frame(rows + clean)).collect()}
    assert not any(r.base_failed for r in out.values())
    assert [out[k].kept for k in range(len(out))] == [False] * len(rows) + [True] * len(clean)


def test_long_texts_that_are_partly_noise_or_template(frame, prose):
    rng = random.Random(8)
    fill = {"noise": lambda n: noise_words(rng, n, "base64"),
            "template": lambda n: " ".join(f"buy cheap pills {rng.randrange(10 ** 6)} now" for _ in range(n // 20))}

    def mixed(size, share, kind):
        words = prose(size // 4).split()
        clean, at = " ".join(words).encode()[:int(size * (1 - share))].decode(errors="ignore"), rng.randrange(size // 3)
        return f"{clean[:at]} {fill[kind](int(size * share))} {clean[at:]}"

    cases = [(size, share, kind) for size in (10_240, 20_480, 60_000) for share in (0.2, 0.3, 0.45) for kind in fill]
    cases += [(300_000, 0.03, kind) for kind in fill]
    rows = [mixed(*c) for c in cases] + [prose(size // 6) for size in (10_240, 20_480, 60_000, 300_000)]
    out = {r.doc_id: r for r in compression.score(frame(rows)).collect()}
    assert not any(r.base_failed for r in out.values())
    assert [c for k, c in enumerate(cases) if out[k].kept] == []
    assert all(out[k].kept for k in range(len(cases), len(rows)))


def test_repeat_words_both_encodings():
    rng = random.Random(5)
    for size in (5, 300, 9000):
        words = [b"%d" % rng.randrange(size) for _ in range(600)]
        if size == 9000:
            words = [b"%d" % k for k in range(9000)] + words[:20] + [b"x"] + words[:20]
        text = " ".join(w.decode() for w in words)
        assert compression.repeat_words(words) == base(text)[4]


def test_empty(frame):
    assert compression.score(frame([])).count() == 0 and compression.apply_rules(frame([])).count() == 0
