import hashlib
from itertools import product

from pulseloom.llm.lines import MIN_WORDS, dedup_lines, line_report, within_one

from .fixtures import frame, key, odd_documents


def distance(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            last, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, last + (x != y))
    return d[-1]


def brute(rows):
    """The text that stays of each row, by comparing every line with every earlier one."""
    place = lambda r: (r[0] is None, r[0] or 0)
    first = {}
    texts = {}
    for r in sorted(rows, key=lambda r: (place(r), r[1] or "")):
        for k, line in enumerate((r[1] or "").split("\n")):
            if line.split():
                first.setdefault(tuple(line.split()), (place(r), r[1], k))
                texts[r[1]] = True
    gone = {a for a, b in product(first, first) if first[b][0] < first[a][0] or first[b][0] == first[a][0] and first[b][2] < first[a][2] if min(len(a), len(b)) >= MIN_WORDS and abs(len(a) - len(b)) < 2 and distance(a, b) == 1}
    out = []
    for r in rows:
        if r[1] is None:
            out.append((r[0], None))
            continue
        lines = r[1].split("\n")
        keep = [x for k, x in enumerate(lines) if not x.split() or (first[tuple(x.split())] == (place(r), r[1], k) and tuple(x.split()) not in gone)]
        text = "\n".join(keep)
        out.append((r[0], r[1] if len(keep) == len(lines) else text if text.strip() else ""))
    return out


def test_against_brute_force(spark):
    rows = [r for r in odd_documents() if r[0] != 3004]
    rows += [(5000, "one two three four five six seven eight nine\nshort line", "en", "s", 1), (5001, "one two three four five six seven nine\nshort lines", "en", "s", 1), (5002, "one two three four five six seven eight eight nine\nshort line", "en", "s", 1)]
    df = frame(spark, rows, extra=("line", "h", "words"))
    out = dedup_lines(df)
    assert out.columns == df.columns
    assert sorted([(r.doc_id, r.text) for r in out.collect()], key=key) == sorted(brute(rows), key=key)


def test_report_and_whole_copies(spark):
    rows = [(2, "a b c\nd e f", "", "", 1), (1, "d e f\na  b c", "", "", 1), (3, None, "", "", 1)]
    got = {r.doc_id: r for r in line_report(frame(spark, rows)).collect()}
    assert (got[1].n_kept, got[1].n_dropped, got[2].n_kept, got[2].n_dropped, got[3].n_kept) == (2, 0, 0, 2, 0)
    assert got[2].kept_sha256 == hashlib.sha256(b"").hexdigest()
    assert line_report(frame(spark, [])).count() == 0


def test_within_one():
    words = "a b c d".split()
    assert within_one(words, words) and within_one(words, words[:-1]) and within_one(words[1:], words) and within_one(words, "a x c d".split())
    assert not within_one(words, "a x c y".split()) and not within_one(words, words[:2]) and not within_one("a b".split(), "b a".split())


def test_columns_of_any_name_pass_through(spark):
    names = ["doc_key", "__key", "__gone", "__gone_key", "key", "h", "first", "n", "near", "line", "words", "k1", "id", "at", "content", "first_key", "first_line"]
    rows = [r for r in odd_documents() if r[0] != 3004]
    out = dedup_lines(frame(spark, rows, extra=names), "n_gone")
    assert out.columns == [*frame(spark, rows, extra=names).columns, "n_gone"]
    got = out.collect()
    assert all(r[c] == f"own {c}" for r in got for c in names)
    assert sorted([(r.doc_id, r.text) for r in got], key=key) == sorted(brute(rows), key=key)


def test_five_words_are_enough():
    assert MIN_WORDS == 5


def test_short_lines_with_one_edit(spark):
    rows = [(1, "one two three four five", "", "", 1), (2, "one two three four six", "", "", 1), (3, "one two three four", "", "", 1), (4, "one two three", "", "", 1), (5, "one two  three four five", "", "", 1), (6, "zero one two three four five", "", "", 1)]
    got = {r.doc_id: r.text for r in dedup_lines(frame(spark, rows)).collect()}
    assert got == {1: rows[0][1], 2: "", 3: rows[2][1], 4: rows[3][1], 5: "", 6: ""}
