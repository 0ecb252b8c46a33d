"""License notices wrapped over lines, inside prose, side by side and repeated; windows against all windows by brute force."""

import random

import pytest

from riskloom.llm import licenses

APACHE = licenses.TEMPLATES["Apache-2.0"].rsplit(" Licensed under", 1)[0]
GPL = licenses.TEMPLATES["GPL-3.0"].rsplit(" This work", 1)[0]


def _wrapped(text, width, edge=""):
    lines, line = [], []
    for w in text.split():
        line.append(w)
        if len(" ".join(line)) > width:
            lines.append(edge + " ".join(line))
            line = []
    return "\n".join(lines + ([edge + " ".join(line)] if line else []))


def _found(text):
    return [(a, b, name) for a, b, name, *_ in licenses.notices(text, 0.15, 4)]


@pytest.mark.parametrize("width", [30, 60, 79, 5000])
@pytest.mark.parametrize("edge", ["", "# ", " * "])
def test_a_wrapped_notice_is_one(width, edge):
    body = _wrapped(APACHE, width, edge)
    n = body.count("\n")
    got = _found(f"Some head\n\n{body}\n\nother text")
    assert got == [(2, 2 + n, "Apache-2.0")]


def test_a_notice_inside_prose_is_found_and_measured():
    last = "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"
    prose = "we walked along the river and spoke of many things that day as " * 3
    (row,) = licenses.notices(f"first line\n{prose} {last} {prose}", 0.15, 4)
    assert row[:3] == (1, 1, "Apache-2.0") and row[4] == len(licenses.words(last)) and row[5] == 0


def test_notices_side_by_side_and_repeated():
    assert [x[2] for x in _found(f"{_wrapped(APACHE, 70)}\n{_wrapped(GPL, 70)}")] == ["Apache-2.0", "GPL-3.0"]
    assert [x[2] for x in _found("\n".join([_wrapped(GPL, 50)] * 30))] == ["GPL-3.0"] * 30
    assert [x[2] for x in _found(" ".join([GPL] * 5))] == ["GPL-3.0"] * 5


def test_short_lines_and_prose_with_cue_words():
    assert _found("This work is licensed under the GNU Lesser General Public License, version 3.") == [(0, 0, "LGPL-3.0")]
    assert _found("RELEASED UNDER THE MIT LICENSE.\n\nx") == [(0, 0, "MIT")]
    assert _found("plain\nAll rights reserved.") == [(1, 1, "Proprietary")]
    for text in ("", "\n\n", "permission to speak was never asked", "they said all rights reserved seats were gone", "the license of the car and the copyright of the song", "Permission " * 5000):
        assert _found(text) == []


def test_a_few_changed_words_are_counted():
    changed = GPL.replace("free software", "fine software").replace("redistribute", "share")
    (row,) = licenses.notices(changed, 0.15, 4)
    assert row[2] == "GPL-3.0" and row[5] == 2
    assert not licenses.notices(" ".join(w if k % 3 else "other" for k, w in enumerate(GPL.split())), 0.15, 4)


def test_windows_have_no_longer_neighbour_of_better_share():
    """Each window's words stand in runs for the most part, and every run of the template lies in some window."""
    rng = random.Random(2)
    runs = licenses._runs()["GPL-3.0"]
    body = licenses.words(GPL)
    for _ in range(60):
        text = [rng.choice("abcd") for _ in range(rng.randrange(20))] + body[rng.randrange(20):rng.randrange(25, len(body))] + [rng.choice("abcd") for _ in range(rng.randrange(20))]
        got = list(licenses.windows(text, runs, 0.15))
        hit = [any(tuple(text[k:k + 3]) in runs for k in (i - 2, i - 1, i) if k >= 0) for i in range(len(text))]
        assert all(hit[a] and hit[b - 1] and sum(hit[a:b]) >= 0.85 * (b - a) - 1e-9 for a, b in got)
        assert all(any(a <= i < b for a, b in got) for i, h in enumerate(hit) if h)
        assert all(b <= c for (_, b), (c, _) in zip(got, got[1:]))


def test_scan_of_odd_rows(spark):
    rows = [(1, APACHE), (1, APACHE), (2, None), (3, ""), (None, "Licensed under CC BY-NC 4.0."), (4, "word " * 60000 + "\nLicensed under CC BY 4.0."), (5, "é▁ü 日本 license")]
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], "doc_id long, text string, license string, line int")
    got = sorted(((r["doc_id"] or -1, r["line"], r["license"]) for r in licenses.op1(df).collect()))
    assert got == [(-1, 0, "CC-BY-NC-4.0"), (1, 0, "Apache-2.0"), (1, 0, "Apache-2.0"), (4, 1, "CC-BY-4.0")]
    assert licenses.op1(df.limit(0)).count() == 0


def test_scan_of_the_table_equals_the_plain_loop(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = sorted((r["doc_id"], *x[:3]) for r in table.collect() for x in licenses.notices(r["text"] or "", 0.15, 4))
    assert sorted((r["doc_id"], r["line"], r["last_line"], r["license"]) for r in licenses.op1(table).collect()) == want and want
