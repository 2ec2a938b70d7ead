"""Licence scans: stretches of a text that are a licence's wording, or nearly.

Texts and templates are normalised to lower-case words (letters and digits, with dots between digits). A stretch of
whole sentences or lines is compared with a template by the Dice coefficient of their word bigrams, repeats counted,
2 * shared / (size + size); at ``threshold`` or above it is a candidate.

Pruning loses nothing. Sizes: a Dice of t needs sizes within a factor of t / (2 - t) of each other, so a template is looked for
in stretches of at most its size over that. Words: a match shares at least that part of the template's bigrams, so of any set of
words whose bigrams are more than the rest, it has one; the longest words of each template that suffice, function words
last, are its anchors, and only texts that hold one are looked at.

For each template, one window of its largest size slides over the places of its bigrams in the text, with counts in and out. Where the
window holds too few of them, no stretch that begins there can match. Stretches that begin or end with sentences that add
nothing are left out: the shorter one within is more similar. The work is linear in the text.

Of overlapping candidates the most similar is kept, then the longer, then the earlier. Each document is judged where it lies;
there is no shuffle. Repeated lines are found each time they occur.

Cases: null and empty texts have no finding; repeated rows are scanned alike; ties go to the smaller
template, then to the one given first; rows without doc_id are scanned too; an empty table gives none; other columns play no part.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from logspark.llm.common import texts
from logspark.llm.license_texts import TEMPLATES

THRESHOLD = 0.8
_WORD = re.compile(r"\d+(?:\.\d+)+|[^\W_]+")
#: Function words, the last resort as anchors.
_COMMON = frozenset("this that with from have been will your which their there they what when were where who the and for are not".split())
#: A stretch may begin and end at line ends and after sentences.
_BREAK = re.compile(r"\n|(?<=[.!?;:])\s")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


class Scanner:
    def __init__(self, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD) -> None:
        self.threshold, self.part = threshold, threshold / (2 - threshold)
        self.known = []
        for licence, text in templates:
            words = words_of(text)
            bigrams = Counter(zip(words, words[1:]))
            if bigrams:
                self.known.append((licence, bigrams))
        #: Ties go to the smaller template.
        self.known.sort(key=lambda known: known[1].total())
        self.anchors = frozenset().union(*[self._anchors(bigrams) for _, bigrams in self.known])
        #: Which templates have a bigram.
        self.having: dict[tuple[str, str], list[int]] = defaultdict(list)
        for n, (_, bigrams) in enumerate(self.known):
            for pair in bigrams:
                self.having[pair].append(n)

    def _anchors(self, bigrams: Counter) -> set[str]:
        """Words such that less than a match must share has none of them."""
        chosen: set[str] = set()
        for word in sorted({w for pair in bigrams for w in pair}, key=lambda w: (w in _COMMON, -len(w), w)):
            free = sum(count for pair, count in bigrams.items() if not chosen.intersection(pair))
            if free < self.part * bigrams.total() - 1e-9:
                break
            chosen.add(word)
        return chosen

    def _like(
        self, template: int, places: list[int], pairs: list[tuple[str, str]], stretch: list[int], ends: list[int],
    ) -> Iterator[tuple[float, int, int]]:
        """(similarity, first, last stretch) of what is like a template.

        ``places`` are those of its bigrams among ``pairs``, the bigrams of the text; ``stretch`` gives each word's stretch and
        ``ends`` the number of words before each stretch.
        """
        own = self.known[template][1]
        size = own.total()
        longest, needed = int(size / self.part + 1e-9), self.part * size - 1e-9
        window: Counter[tuple[str, str]] = Counter()
        held = low = high = 0
        first = -1
        for place in places:
            if stretch[place] == first:
                continue
            first = stretch[place]
            begin = ends[first]
            while high < len(places) and places[high] < begin + longest:
                pair = pairs[places[high]]
                held += window[pair] < own[pair]
                window[pair] += 1
                high += 1
            while places[low] < begin:
                pair = pairs[places[low]]
                window[pair] -= 1
                held -= window[pair] < own[pair]
                low += 1
            if held < needed:
                continue
            seen: Counter[tuple[str, str]] = Counter()
            shared, grown = 0, False
            for at in range(low, high):
                pair, last = pairs[places[at]], stretch[places[at] + 1]
                seen[pair] += 1
                if seen[pair] <= own[pair]:
                    shared, grown = shared + 1, True
                if grown and (at + 1 == high or stretch[places[at + 1] + 1] != last):
                    grown = False
                    similarity = 2 * shared / (ends[last + 1] - begin - 1 + size)
                    if similarity >= self.threshold:
                        yield similarity, first, last

    def scan(self, text: str) -> list[tuple[str, float, int, int]]:
        """(licence, similarity, start, stop) in characters, in order."""
        if self.anchors.isdisjoint(words_of(text)):
            return []
        bounds: list[tuple[int, int]] = []
        words: list[str] = []
        stretch: list[int] = []
        ends, at = [0], 0
        for cut in [*(m.end() for m in _BREAK.finditer(text)), len(text)]:
            part = text[at:cut]
            if inside := words_of(part):
                stretch += [len(bounds)] * len(inside)
                bounds.append((at, at + len(part.rstrip())))
                words += inside
                ends.append(len(words))
            at = cut
        pairs = list(zip(words, words[1:]))
        places: dict[int, list[int]] = defaultdict(list)
        for place, pair in enumerate(pairs):
            for template in self.having.get(pair, ()):
                places[template].append(place)
        candidates = []
        for template, own in places.items():
            for similarity, first, last in self._like(template, own, pairs, stretch, ends):
                start, stop = bounds[first][0], bounds[last][1]
                candidates.append((-similarity, start - stop, start, stop, template))
        taken: list[tuple[int, int]] = []
        found = []
        for similarity, _, start, stop, template in sorted(candidates):
            # ``taken`` is sorted and disjoint: only its neighbours can overlap.
            place = bisect_left(taken, (start, stop))
            if (place and taken[place - 1][1] > start) or (place < len(taken) and taken[place][0] < stop):
                continue
            taken.insert(place, (start, stop))
            found.append((self.known[template][0], -similarity, start, stop))
        return sorted(found, key=lambda f: f[2])


def licences(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, licence, similarity, start, stop, matched): one row per stretch found, in code points of the text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, threshold)
        for batch in batches:
            rows = [
                (doc_id, licence, similarity, start, stop, text[start:stop])
                for doc_id, text in zip(batch.column(0).to_pylist(), (t.as_py() for t in batch.column(1)))
                for licence, similarity, start, stop in scanner.scan(text)]
            columns = zip(*rows) if rows else [[]] * 6
            kinds = (pa.int64(), pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                             ["doc_id", "licence", "similarity", "start", "stop", "matched"])

    return texts(docs).mapInArrow(
        run, "doc_id bigint, licence string, similarity double, start int, stop int, matched string")
