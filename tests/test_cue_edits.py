"""Captions and hand edits: each word laid once, cues made once, edits as a plain loop applies them."""

import random
import time

from timeweave.operators import captions
from timeweave.plans import speech

SMOKE = "/root/testdata/sf0.001"


def test_a_long_cue_costs_what_its_words_cost():
    words = [f"w{i % 97}" for i in range(20_000)]
    began = time.time()
    cues = captions.split_cues(" ".join(words), 0, 3_000, 1_000_000, 1)
    assert time.time() - began < 2
    assert [t for _, _, t in cues] == ["W" + " ".join(words)[1:]]


def test_cues_are_those_of_packing_each_cue_anew():
    rng = random.Random(5)
    for _ in range(300):
        chars, lines, text = rng.randint(3, 20), rng.randint(1, 3), " ".join("x" * rng.randint(1, 25) for _ in range(rng.randint(1, 40)))
        end = rng.choice([1_000, 9_000, 60_000])
        words = [w[i : i + chars] for w in text.split() for i in range(0, len(w), chars)]
        letters = sum(map(len, words))
        wanted = max(int(end / captions.CUE_MS + 0.5), -(-letters // (chars * lines)), 1)
        most = min(chars * lines, -(-letters // wanted)) if wanted > 1 else chars * lines
        want = [[]]
        for w in words:
            grown = want[-1] + [w]
            if want[-1] and (len(" ".join(grown)) > most or captions.pack_lines(grown, chars, lines) is None):
                want.append([w])
            else:
                want[-1].append(w)
        got = [t.lower() for _, _, t in captions.split_cues(text, 0, end, chars, lines)]
        assert got == ["\n".join(captions.pack_lines(c, chars, lines)) for c in want]


def test_edited_cues_are_made_once(spark):
    assert not [f for f in speech.w33_cue_edits(spark, SMOKE).inputFiles() if "conversations" in f]


def plain(cues, edits):
    """Edits in order, each on the best cue still free; then overlaps by start."""
    chosen = {}
    for e in sorted(edits):
        _, edit, video, ea, eb, *_ = e
        scored = []
        for _, cue, a, b, _, v, sa, sb, *_ in cues:
            if v != video:
                continue
            share = max(min(sb, eb) - max(sa, ea), 0) / (max(sb, eb) - min(sa, ea))
            if abs(sa - ea) <= 350 and abs(sb - eb) <= 350:
                scored.append(((abs(sa - ea) + abs(sb - eb)) / 1e3, cue))
            elif share >= 0.6:
                scored.append((2 - share, cue))
        free = [c for _, c in sorted(scored) if c not in chosen]
        if free:
            chosen[free[0]] = e
    out = []
    for _, cue, a, b, text, _, _, _, offset, least, most in cues:
        e = chosen.get(cue)
        if e:
            text = e[5].strip() if e[5] and e[5].strip() else text
            a = a if e[6] is None else min(max(e[6] + offset, least), most)
            b = b if e[7] is None else min(max(e[7] + offset, least), most)
            b = max(b, a + 100) if b < a + 100 else b
        out.append([cue, float(a), float(b), text, bool(e and (e[5] is not None or e[6] is not None or e[7] is not None)), bool(e and e[8])])
    out.sort(key=lambda c: (c[1], c[0]))
    seen = [c for c in out if not c[5]]
    for one, two in zip(seen, seen[1:]):
        if one[2] > two[1]:
            if one[4] and not two[4]:
                two[1] = one[2]
            else:
                one[2] = two[1]
    return sorted(tuple(c) for c in out if c[2] > c[1] + 10)


def test_edits_as_a_plain_loop_applies_them(spark):
    rng = random.Random(7)
    cues, edits, at = [], [], 0
    for i in range(400):
        length = rng.choice([200, 400, 900, 2_000])
        source = rng.randint(0, 60_000)
        cues.append((1, i, float(at), float(at + length), f"cue {i}", i % 3, source, source + length, at - source, max(at - 500, 0), at + length + 500))
        if rng.random() < 0.7:
            move = lambda: rng.randint(-300, 300)
            edits.append((1, rng.randint(0, 1 << 40), i % 3, source + move(), source + length + move(), rng.choice([None, " ", " told ", "x"]), rng.choice([None, source + move()]), rng.choice([None, source + length + move()]), rng.random() < 0.2))
        at += length
    edits = [e for e in edits if e[4] > e[3]]
    c = spark.createDataFrame(cues, "script_id long, cue long, start_ms double, end_ms double, text string, video_id long, src_start_ms long, src_end_ms long, offset_ms long, min_ms long, max_ms long")
    e = spark.createDataFrame(edits, "script_id long, edit long, video_id long, src_start_ms long, src_end_ms long, new_text string, new_start_ms long, new_end_ms long, hidden boolean")
    got = sorted((r.cue, r.start_ms, r.end_ms, r.text, r.edited, r.hidden) for r in captions.apply_cue_edits(c, e).collect())
    assert got == plain(cues, edits)
