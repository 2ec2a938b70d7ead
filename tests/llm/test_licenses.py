import random
import time
from collections import Counter

from brute import messy
from logspark.llm import licenses
from logspark.llm.license_texts import FULL, TEMPLATES


def dice(a, b):
    a, b = (Counter(zip(w, w[1:])) for w in map(licenses.words_of, (a, b)))
    return 2 * (a & b).total() / (a.total() + b.total()) if a and b else 0.0


def brute(text):
    """Best similarity of any stretch between breaks, without pruning."""
    cuts = sorted({0, len(text), *(m.end() for m in licenses._BREAK.finditer(text))})
    return max((dice(text[a:b], t) for n, a in enumerate(cuts) for b in cuts[n + 1:] for _, t in TEMPLATES), default=0.0)


def test_pruning_loses_nothing():
    rng = random.Random(5)
    scanner = licenses.Scanner()
    for n in range(60):
        words = rng.choice(TEMPLATES)[1].split()
        for _ in range(rng.randint(0, max(1, len(words) // 6))):
            words[rng.randrange(len(words))] = rng.choice(["other", "word", ""])
        text = "Some plain prose first. More of it here!\n" * rng.randint(0, 2) + " ".join(words) + "\nTail without notice."
        found = scanner.scan(text)
        best = brute(text)
        assert bool(found) == (best >= licenses.THRESHOLD - 1e-12), (text, found, best)
        if found:
            assert abs(max(f[1] for f in found) - best) < 1e-9
            assert all(abs(dice(text[a:b], text[a:b]) - 1) < 1e-9 and s >= 0.8 for _, s, a, b in found)


def plain(text, templates):
    """All stretches against all templates, the most similar first."""
    cuts = sorted({0, len(text), *(m.end() for m in licenses._BREAK.finditer(text))})
    parts = [(a, a + len(text[a:b].rstrip())) for a, b in zip(cuts, cuts[1:]) if licenses.words_of(text[a:b])]
    ordered = sorted(templates, key=lambda t: len(licenses.words_of(t[1])))
    hits = sorted((-s, a - b, a, b, n) for i, (a, _) in enumerate(parts) for _, b in parts[i:]
                  for n, (_, t) in enumerate(ordered) if (s := dice(text[a:b], t)) >= licenses.THRESHOLD)
    kept = []
    for s, _, a, b, n in hits:
        if all(b <= c or d <= a for _, _, c, d in kept):
            kept.append((ordered[n][0], -s, a, b))
    return sorted(kept, key=lambda f: f[2])


def test_all_findings_against_all_stretches():
    rng = random.Random(8)
    templates = [t for t in TEMPLATES if len(t[1].split()) < 30]
    scanner = licenses.Scanner(tuple(templates))
    found = 0
    for n in range(60):
        words = [w for _ in range(3) for w in rng.choice(templates)[1].split()]
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = rng.choice(["other", "the", "license"])
        text = "".join(w + rng.choice("  \n") for w in words)
        got = scanner.scan(text)
        assert got == plain(text, templates)
        found += len(got)
    assert found > 60


def test_one_word_lines_take_linear_time():
    scanner, rng = licenses.Scanner(), random.Random(2)
    known = [word for _, text in TEMPLATES for word in text.split()]
    began = time.monotonic()
    assert scanner.scan("license\n" * 120_000) == []
    scanner.scan("\n".join(rng.choices(known, k=150_000)))
    assert time.monotonic() - began < 30


def test_long_texts_of_the_same_words_take_linear_time():
    scanner = licenses.Scanner()
    assert scanner.scan("license. " * 20_000) == []
    assert len(scanner.scan("Released under the MIT License.\n" * 3_000)) == 3_000


def test_notices_of_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    notices = {"This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
               "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "Released under the MIT License.": "MIT",
               "Licensed under the Apache License, Version 2.0.": "Apache-2.0"}
    want = {(r.doc_id, licence) for r in docs.collect() for notice, licence in notices.items() if notice in r.text}
    got = licenses.licences(docs).collect()
    assert {(r.doc_id, r.licence) for r in got} == want and len(want) > 5
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(texts[r.doc_id][r.start:r.stop] == r.matched for r in got)


def test_whole_licences_and_reflowed_text(spark):
    scanner = licenses.Scanner()
    for licence, text in FULL:
        flowed = "# intro line\n\n" + "\n".join("  " + part for part in text.split("\n")) + "\n\ncode = 1\n"
        assert [f[0] for f in scanner.scan(flowed)] == [licence]


def test_nulls_repeats_and_clashing_names(spark):
    notice = "Released under the MIT License."
    docs = messy(spark, [(1, None), (2, ""), (3, notice), (3, notice), (None, notice), (4, f"é\n{notice}\n" * 3)], "licence")
    got = sorted((r.doc_id or 0, r.licence, r.similarity, r.start) for r in licenses.licences(docs).collect())
    assert got == [(0, "MIT", 1.0, 0), (3, "MIT", 1.0, 0), (3, "MIT", 1.0, 0), *[(4, "MIT", 1.0, 2 + 34 * n) for n in range(3)]]
    assert licenses.licences(docs.limit(0)).collect() == []


def test_each_header_gets_its_own_id():
    scanner = licenses.Scanner()
    header = ("{0} is free software{3} you can redistribute it and/or modify\nit under the terms of the GNU {1} as published by\n"
              "the Free Software Foundation{4} either version {2} of the License, or\n(at your option) any later version.\n\n"
              "{0} is distributed in the hope that it will be useful,\nbut WITHOUT ANY WARRANTY; without even the implied "
              "warranty of\nMERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the\nGNU {1} for more details.\n\n"
              "You should have received a copy of the GNU {1}\nalong with {5}{6}\n")
    gpl, lesser, affero = "General Public License", "Lesser General Public License", "Affero General Public License"
    old = "; if not, write to the Free Software\nFoundation, Inc., 59 Temple Place, Suite 330, Boston, MA 02111-1307 USA"
    new = ".  If not, see <https://www.gnu.org/licenses/>."
    for licence, parts in {
        "GPL-2.0": ("This program", gpl, "2", ";", ";", "this program", old),
        "LGPL-2.1": ("This library", lesser, "2.1", ";", ";", "this library", old),
        "GPL-3.0": ("This program", gpl, "3", ":", ",", "this program", new),
        "LGPL-3.0": ("This program", lesser, "3", ":", ",", "this program", new),
        "AGPL-3.0": ("This program", affero, "3", ":", ",", "this program", new),
    }.items():
        assert [f[0] for f in scanner.scan(f"A tool.\n\n{header.format(*parts)}\nint main() {{}}\n")] == [licence]
    bodies = dict(FULL)
    for licence in ("BSD-2-Clause", "BSD-3-Clause", "Unlicense", "CC0-1.0"):
        assert [f[0] for f in scanner.scan(f"Copyright (c) 2020, A. Author\n\n{bodies[licence]}\n")] == [licence]
