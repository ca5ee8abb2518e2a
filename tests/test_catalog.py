"""Every query of the catalogue against its SQL, or for content where SQL has no such operator."""

import pytest
from conftest import same_rows

from cuelake.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):
    same_rows(QUERIES[name](spark, SF), duck, ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


@pytest.mark.parametrize("name", ["gate_report", "premerge", "best_overlap"])
def test_partitions_do_not_matter(spark, name):
    found = []
    for n in ("1", "4", "16"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        found.append(sorted(map(str, QUERIES[name](spark, SF).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert found[0] == found[1] == found[2]


def lane(spark, *names):
    """The given cues, and lanes made of them, as lists of rows by file in order."""
    from cuelake.sources import adapters

    c = adapters.cues(spark, SF)
    out = []
    for name in names:
        rows = {}
        for r in (c if name == "cues" else getattr(adapters, name)(c)).orderBy("file_id", "pos").collect():
            rows.setdefault(r.file_id, []).append(r)
        out.append(rows)
    return out


def best(row, rows):
    found, most = None, 0
    for r in rows:
        over = min(row.end_ms, r.end_ms) - max(row.start_ms, r.start_ms)
        if row.end_ms > row.start_ms and over > most:
            found, most = r, over
    return found


def test_lanes_against_brute_force(spark):
    import re
    from difflib import SequenceMatcher

    marks = re.compile("[\\s，。、！？…!?~〜·「」『』,.!?：:；;（）()【】《》〈〉\\[\\]\"'“”‘’—－_／/]+")
    merged, first, second = lane(spark, "merged", "cues", "second_pass")
    expected = {}
    for f, rows in merged.items():
        for m in rows:
            a, b = best(m, first.get(f, [])), best(m, second.get(f, []))
            if a and b:
                x, y = marks.sub("", a.text), marks.sub("", b.text)
                ratio = SequenceMatcher(None, x, y).ratio() if x and y else 0.0
                artifact = min(len(x), len(y)) <= 3 and max(len(x), len(y)) >= 4 and ratio < 0.3
                expected[f, m.pos] = (a.pos, b.pos, round(ratio, 9), "artifact" if artifact else "must_see" if ratio < 0.3 else "optional" if ratio < 0.5 else "none")
    got = {(r.file_id, r.pos): (r.pos1, r.pos2, round(r.similarity, 9), r.group) for r in QUERIES["pass_disagreement_blocks"](spark, SF).collect()}
    assert got == expected


def test_one_to_one_against_brute_force(spark):
    left, right = lane(spark, "cues", "second_pass")
    expected = set()
    for f, rows in left.items():
        used = set()
        for m in rows:
            over = [(min(m.end_ms, r.end_ms) - max(m.start_ms, r.start_ms), -k, r.pos) for k, r in enumerate(right.get(f, [])) if r.pos not in used]
            most = max((x for x in over if x[0] > 200), default=None)
            if most:
                used.add(most[2])
                expected.add((f, m.pos, most[2], most[0]))
    assert {tuple(r) for r in QUERIES["side_by_side"](spark, SF).select("file_id", "pos", "r_pos", "overlap_ms").collect()} == expected


def folded(rows, gap, allow, glue):
    out, cur = [], None
    for r in rows:
        x = {"start": r.start_ms, "end": r.end_ms, "text": r.text.strip(), "n": 1, "last": r.text.strip(), "pos": r.pos}
        if cur and r.start_ms - cur["end"] <= gap and allow(cur, x):
            cur = cur | {"end": x["end"], "text": cur["text"] + glue + x["text"], "n": cur["n"] + 1, "last": x["text"]}
        else:
            out += [cur] if cur else []
            cur = x
    return out + ([cur] if cur else [])


def test_folds_against_brute_force(spark):
    import re

    (cues,) = lane(spark, "cues")
    complete, pause = re.compile(r"(?:です|ます|んだ|のだ|よね|ない|た|だ|か[。？?]?|[。！？?！])\s*$"), re.compile(r"(?:…|⋯|〜|~)\s*$")

    def allow(cur, x):
        prev, text = cur["text"], x["text"]
        core = re.sub(r"(?:…|⋯|〜|~)+\s*$", "", prev)
        gap = x["start"] / 1000 - cur["end"] / 1000
        wanted = gap <= 0.5 and not complete.search(core) and len(text) < 6
        veto = (pause.search(prev) and (complete.search(text) or pause.search(text))) or (complete.search(prev) and complete.search(text) and gap > 0.2)
        return prev and text and wanted and not veto and x["end"] - cur["start"] <= 5000 and len(prev) + len(text) <= 80 and cur["n"] < 3

    expected = {(f, x["pos"], x["text"], x["n"]) for f, rows in cues.items() for x in folded(rows, 1001, allow, "")}
    assert {(r.file_id, r.pos, r.text, r.members) for r in QUERIES["premerge"](spark, SF).collect()} == expected and any(n > 1 for *_, n in expected)

    def joined(cur, x):
        return cur["n"] < 3 and x["end"] - cur["start"] <= 8000

    commas = {f: [type("Cue", (), r.asDict() | {"text": r.text if r.text.endswith(",") else r.text[:-1] + ","}) for r in rows] for f, rows in cues.items()}
    expected = {(f, x["pos"], x["text"], x["n"]) for f, rows in commas.items() for x in folded(rows, 500, joined, " ")}
    assert {(r.file_id, r.pos, r.text, r.members) for r in QUERIES["fragment_merge"](spark, SF).collect()} == expected
    # The sources of a merged row are those of all rows inside its span, with 1 ms of play.
    spans = {(f, x["pos"]): (x["start"], x["end"]) for f, rows in commas.items() for x in folded(rows, 500, joined, " ")}
    more = 0
    for r in QUERIES["merge_evidence"](spark, SF).collect():
        start, end = spans[r.file_id, r.pos]
        inside = [x.text for x in cues[r.file_id] if x.start_ms >= start - 1 and x.end_ms <= end + 1]
        assert sorted(r.evidence.split("|")) == sorted("|".join(inside).split("|"))
        more += len(inside) > r.members
    assert more


def test_legacy_encodings_against_brute_force(spark):
    import hashlib
    import re

    import pandas as pd

    docs = pd.read_parquet(f"{SF}/documents.parquet")
    got = {r.file_id: r for r in QUERIES["decode_legacy"](spark, SF).collect()}
    for k, text in zip(docs["doc_id"], docs["text"], strict=True):
        raw, found = re.sub("[^\x00-\xff]", "?", text).encode("latin-1"), (None, None)
        for name in ("utf-8", "cp932", "gb18030"):
            try:
                found = (name, hashlib.md5(raw.decode(name).encode()).hexdigest())
                break
            except UnicodeDecodeError:
                pass
        assert (got[k].encoding, got[k].digest) == found
    assert len({r.encoding for r in got.values()}) > 2


def test_cleaner_against_brute_force(spark):
    """Every verdict of the catalogue's rules over the whole table, row by row in plain Python."""
    import re

    from cuelake.catalog_lanes import _TINY as rules

    (cues,) = lane(spark, "cues")
    marks = re.compile(r"[，。、！？\s,\.!?…~～]")
    has = lambda words, t: any(w in t for w in words)

    def substance(t):
        rest = marks.sub("", t)
        for w in (*rules.sensory, *rules.particles, *rules.degrees):
            rest = rest.replace(w, "")
        return has(rules.actions, rest)

    def root(t):
        s = t.strip()
        first = marks.sub("", s)[:1]
        return next((w for w in rules.sensory if w in s), first if first and first in "".join(rules.exclamations) else None)

    def alone(t):
        b = marks.sub("", t.strip())
        def left(b, w):
            for x in (w, *rules.beside):
                b = b.replace(x, "")
            return b

        return any(w in t.strip() and left(b, w) == "" for w in rules.sensory)

    expected = {}
    for f, rows in cues.items():
        hard = [has(rules.hardened, r.text.strip()) or any(re.search(p, r.text.strip()) for p in rules.hardened_patterns) for r in rows]
        sub = [substance(r.text) for r in rows]
        content = [a or b for a, b in zip(hard, sub, strict=True)]
        plain = [len(r.text) <= 10 and not s for r, s in zip(rows, sub, strict=True)]
        protected, i = set(), 0
        while i < len(rows):
            j = i
            while plain[i] and j + 1 < len(rows) and plain[j + 1] and rows[j + 1].start_ms - rows[j].end_ms <= 3000:
                j += 1
            protected |= set(range(i, j + 1)) if plain[i] and j - i >= 2 else set()
            i = j + 1
        seg, at = [], 0
        for k, r in enumerate(rows):
            at += int(k == 0 or r.start_ms - rows[k - 1].end_ms > 1500)
            seg.append(at)
        for k, r in enumerate(rows):
            s, b = r.text.strip(), marks.sub("", r.text.strip())
            nxt = next((rows[j].start_ms for j in range(k + 1, len(rows)) if content[j]), None)
            before = next((rows[j].start_ms for j in range(k - 1, -1, -1) if content[j] and seg[j] == seg[k]), None)
            after = next((rows[j].start_ms for j in range(k + 1, len(rows)) if content[j] and seg[j] == seg[k]), None)
            again = root(r.text) is not None and any(root(rows[j].text) == root(r.text) and seg[j] != seg[k] and 0 <= r.start_ms - rows[j].start_ms <= 60_000 for j in range(k - 1, max(k - 400, -1), -1))
            tests = [
                ("L3-meta", len(s) <= 30 and has(rules.meta_strong, s) or len(s) <= 40 and has(rules.meta_strong, s) and has(rules.meta_weak, s), False), ("L4-parenthetical", bool(re.search(rules.parenthetical, s)) and not has(rules.hardened, s[1:-1]), False),
                ("L5-garbage", any(re.match(p, s) for p in rules.garbage), False), ("L6-pure-exclamation", b.replace("—", "") in rules.exclamations, False), ("L7-sensory", alone(r.text), True), ("L8-short-response", b in rules.short, True),
                ("L9-filler", b in rules.fillers, False), ("L10-address", any(b.endswith(w) and len(b) - len(w) <= 2 for w in rules.addresses), False), ("L11-60s-dedup", again, True), ("L12-non-chinese-short", len(b) <= 2 and not re.search("[一-鿿]", b), False),
            ]
            source = None if r.pos % 3 == 0 else "ああああああ" if r.pos % 2 == 0 else "abc"
            rule = "keep"
            if k in protected:
                rule = "protected-run"
            elif hard[k]:
                rule = "L0-hardened"
            elif nxt is not None and nxt - r.end_ms <= 3000:
                rule = "L1-linked"
            elif any(x is not None and abs(x - r.start_ms) <= 3000 for x in (before, after)):
                rule = "L2-segment-content"
            else:
                name, gated = next(((n, g) for n, t, g in tests if t), (None, False))
                if name:
                    rule = "kept-no-evidence" if source is None else "kept-by-noise-gate" if gated and source == "abc" else name
            expected[f, r.pos] = (seg[k], rule)
    got = {(r.file_id, r.pos): (r.segment, r.rule) for r in QUERIES["clean_rules"](spark, SF).collect()}
    assert got == expected and len({rule for _, rule in expected.values()}) > 5


def test_files_are_isolated(spark):
    from pyspark.sql import functions as F

    from cuelake.operators import gate
    from cuelake.sources import adapters

    cues = adapters.cues(spark, SF)
    one = gate.classify(cues.filter("file_id = 3"))
    among = gate.classify(cues).filter("file_id = 3")
    assert sorted(map(str, one.collect())) == sorted(map(str, among.select(*one.columns).collect()))
    assert cues.filter(F.col("file_id") == 3).count() == one.count()


@pytest.mark.parametrize("name", ["vtt_to_cues", "ass_to_cues"])
def test_long_files_are_converted_whole(spark, tmp_path, name):
    # 95 sentences: the cues after the fortieth come out too, with the places and texts of the cues that went in.
    from cuelake.sources import adapters

    text = " ".join(f"Sentence number {k}." for k in range(95))
    spark.createDataFrame([(1, text, "en"), (2, "One. Two.", "en")], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    step = 1 if name == "vtt_to_cues" else 10
    expected, end = [], {}
    for c in sorted(adapters.cues(spark, str(tmp_path)).collect(), key=lambda c: (c.file_id, c.start_ms // step, c.end_ms // step, c.pos)):
        first, last = c.start_ms // step * step, c.end_ms // step * step
        expected.append((c.file_id, max(first, end.get(c.file_id, first)), last, c.text))
        end[c.file_id] = last
    got = sorted((r.file_id, r.start_ms, r.end_ms, r.text) for r in QUERIES[name](spark, str(tmp_path)).collect())
    assert len(got) == 97 and got == sorted(expected)


def test_energy_runs_to_the_end_of_each_file(spark, tmp_path):
    from cuelake.operators import audio
    from cuelake.sources import adapters

    text = " ".join(f"Sentence number {k}." for k in range(95))
    spark.createDataFrame([(3, text, "en"), (4, "One. Two.", "en")], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    cues = adapters.cues(spark, str(tmp_path))
    ends = {r.file_id: r.e for r in cues.groupBy("file_id").agg({"end_ms": "max"}).withColumnRenamed("max(end_ms)", "e").collect()}
    assert ends[3] > 180_000 > 60_000 > ends[4]
    expected, ratio = [], {}
    for f, end in ends.items():
        rms = [(k // 37 * 7919 + f * 104729) % 1000 for k in range(end // 10)]
        limit = sorted(rms)[round((len(rms) - 1) * 0.85)]
        loud = [k for k, x in enumerate(rms) if x > limit]
        starts = [k for k in loud if k - 1 not in set(loud)]
        expected += [(f, 10 * k, 10 * (next(j for j in range(k, len(rms) + 1) if j == len(rms) or rms[j] <= limit))) for k in starts]
        ratio[f] = 10 * len(loud)
    assert sorted(map(tuple, QUERIES["speech_segments"](spark, str(tmp_path)).collect())) == sorted(expected)
    assert {r.file_id: r.speech_ms for r in QUERIES["speech_ratio"](spark, str(tmp_path)).collect()} == {f: n for f, n in ratio.items() if n}
    h = adapters.hops(cues)
    found = audio.speech_in_gaps(cues, audio.speech_segments(h, audio.threshold(h)), top=1000).collect()
    assert max(r.start_ms for r in found) > 60_000
