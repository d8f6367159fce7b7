"""Free-entered values to a canonical list.

1. A multi-pattern automaton over the canonical names and their aliases finds mentions
   embedded in the value; the longest non-overlapping match wins.  Texts are compared
   without case, accents and separators; names also stand in the spellings ae/oe/ue/aa
   and with some words shortened.
2. Values without a mention go to token-set similarity: the value's tokens, in any order,
   are matched with those of each name by edit distance (insertions, deletions,
   substitutions, swaps), and tokens written apart or together count as joined.  A name's
   similarity is the share of its letters in tokens that are matched, less their edits.
   Candidates come from deletion-neighbourhood indexes over joined names and over each
   name's rarest tokens, built so that no name within the limits is missed.
3. What is left of the value decides between several entries of one place: the word for
   the station exactly, then by its class, else the main entry.

The words that tell stations of a place apart, fillers and shortenings are the parameter
``words``.

Every value has a result: the entry, or "" if none is meant.  Defined results: null and
blank values are no values; very long values are searched whole; a value that fits two
places equally well is "" (ambiguous); repeated list entries count once; an empty list
gives "" throughout.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itinera.session import cut, small

#: Most entries and places of a list that is held by every worker, and most bytes of their texts; the
#: indexes take about a hundred times as many entries.
MOST_NAMES, MOST_NAME_BYTES = 20_000, 16 << 20
#: Most values a worker remembers the answers of.
_REMEMBERED = 200_000

#: Share of a name's letters that must stand in matched tokens.
LEAST_OVERLAP = 0.8


@dataclass(frozen=True)
class Words:
    """Words with a meaning of their own in values.

    classes: kind -> the words that stand for it; "main" is the kind of main entries.
    shortened: first word of a name -> what it is shortened to.  fillers: words without weight.
    """

    classes: dict[str, tuple[str, ...]]
    shortened: dict[str, tuple[str, ...]]
    fillers: frozenset[str]

    @property
    def kind(self) -> dict[str, str]:
        return {w: k for k, words in self.classes.items() for w in words}


# Words for railway stations and airports in European languages, by what they tell apart.
STATION_WORDS = Words(
    classes={
        "main": (
            "hbf", "hauptbahnhof", "hauptbf", "hauptbhf", "hb", "h", "hovedbanegard", "hovedbanegaard", "central", "centr", "cent", "ctrl", "cs", "centraal", "centralstation", "centralen", "c",
            "centrale", "cle", "centralna", "sentralstasjon", "s", "glowna", "glowny", "gl", "hln", "hlavninadrazi", "bahnhof", "bhf", "bf", "gare", "ville", "estacion", "est", "midi", "zuid",
            "zuidmidi", "station", "stn", "main", "stazione",
        ),
        "nord": ("nord", "north", "norte", "n"),
        "sud": ("sud", "sued", "south", "sur", "syd"),
        "west": ("west", "ouest", "oeste", "w"),
        "ost": ("ost", "east", "este", "oest"),
        "airport": ("flughafen", "airport", "aeroport", "aeropuerto", "aeroporto", "lufthavn", "flygplats", "lotnisko", "letiste", "flugh", "apt"),
    },
    shortened={"sankt": ("st", "s", "skt", "saint"), "bad": ("b",)},
    fillers=frozenset({"de", "la", "le", "du", "d", "der", "di", "am", "stop"}),
)
_EXTRA = str.maketrans({"ø": "o", "ł": "l", "đ": "d", "ð": "d", "ı": "i", "æ": "ae", "œ": "oe", "ß": "ss", "þ": "th"})
_GERMAN = str.maketrans({"ä": "ae", "ö": "oe", "ü": "ue", "å": "aa", "ø": "oe"})


def fold(text: str) -> str:
    """Lower case without accents."""
    text = text.casefold().translate(_EXTRA)
    return text if text.isascii() else "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).translate(_EXTRA)


def tokens(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text)


def edits(a: str, b: str, most: int) -> int:
    """Optimal-string-alignment distance, or most + 1 if it is larger."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    # Equal ends take no part: what is left after one slip is a letter or two.
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    start = 0
    while start < len(a) and start < len(b) and a[start] == b[start]:
        start += 1
    a, b = a[start:], b[start:]
    if not a or not b:
        return min(len(a) + len(b), most + 1)
    before: list[int] = []
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            v = min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, before[j - 2] + 1)
            row.append(v)
        if min(row) > most:
            return most + 1
        before, last = last, row
    return min(last[-1], most + 1)


def deletions(text: str, depth: int) -> set[str]:
    out, level = {text}, {text}
    for _ in range(depth):
        level = {t[:i] + t[i + 1 :] for t in level for i in range(len(t))}
        out |= level
    return out


def allowed(length: int) -> int:
    """Edits at which a name of this length still counts as meant."""
    return 0 if length < 5 else 1 if length < 9 else 2


class Matcher:
    """Holds the list; ``meant`` answers a value."""

    def __init__(self, entries: Sequence[tuple[str, str, bool]], places: Sequence[tuple[str, str]], countries: Sequence[str], words: Words = STATION_WORDS) -> None:
        """entries: (name, place or "", is main); places: (place, alias); countries: codes and names that may follow a value."""
        import ahocorasick

        self.words, self.kind = words, words.kind
        #: Answers of the indexes, kept while there are few.
        self.kinds_near: dict[str, set[str]] = {}
        self.near: dict[str, set[str]] = {}
        self.near_token: dict[str, set[int]] = {}
        #: Lengths of the words that may be written together with a name.
        self.tails = sorted({len(w) for w in self.kind if len(w) > 1})
        self.names = {e[0] for e in entries}
        self.countries = {" ".join(tokens(fold(c))) for c in countries if c}
        self.by_place: dict[str, list[tuple[str, str, bool]]] = {}
        forms: dict[tuple[str, ...], set[str]] = {}
        for name, place, main in sorted(set(entries)):
            key = place or name
            word = "".join(tokens(fold(name[len(place) :]))) if place and name.startswith(place) else ""
            self.by_place.setdefault(key, []).append((name, word, main))
            for f in self._forms(name):
                forms.setdefault(f, set()).add(f"={name}")
        for place, alias in places:
            if place in self.by_place and alias.strip():
                for f in self._forms(alias):
                    forms.setdefault(f, set()).add(place)
        for place in self.by_place:
            for f in self._forms(place):
                forms.setdefault(f, set()).add(place)
        joined: dict[str, set[str]] = {}
        for f, targets in forms.items():
            joined.setdefault("".join(f), set()).update(targets)
        #: Compact form -> the places ("=" marks one entry); a form of a place and of its one entry is the place's.
        self.forms = {f: self._plain(t) for f, t in joined.items() if f}
        self.auto = ahocorasick.Automaton()
        for f in self.forms:
            self.auto.add_word(f, f)
        if self.forms:
            self.auto.make_automaton()
        self.index: dict[str, list[str]] = {}
        for f in self.forms:
            for x in deletions(f, allowed(len(f))):
                self.index.setdefault(x, []).append(f)
        #: Lengths between which a run of tokens can be within the edits of some form.
        self.least = min((len(f) - allowed(len(f)) for f in self.forms if allowed(len(f))), default=1)
        self.most = max((len(f) + allowed(len(f)) for f in self.forms), default=0)
        self.longest_word = max(map(len, self.kind), default=0)
        #: Names of several tokens, as sets; each is found by its rarest tokens, of which one must match.
        self.sets = sorted({(tuple(sorted(f)), "".join(f)) for f in forms if len(f) > 1})
        often = Counter(x for f, _ in self.sets for x in set(f))
        self.rare: dict[str, set[int]] = {}
        for n, (f, _) in enumerate(self.sets):
            left = sum(map(len, f))
            enough = LEAST_OVERLAP * left
            for x in sorted(f, key=lambda x: (often[x], -len(x), x)):
                if left < enough:
                    break
                left -= len(x)
                for y in deletions(x, allowed(len(x))):
                    self.rare.setdefault(y, set()).add(n)

    def _plain(self, targets: set[str]) -> set[str]:
        places = {t for t in targets if t[0] != "="}
        own = {f"={n}" for p in places for n, word, _ in self.by_place[p] if not word}
        return (targets - own) if places else targets

    def _forms(self, name: str) -> set[tuple[str, ...]]:
        """The name as tokens, in its spellings."""
        out = set()
        for text in (fold(name), fold(name.casefold().translate(_GERMAN))):
            t = tokens(text)
            heads = [t[0], *self.words.shortened.get(t[0], ())] if len(t) > 1 else t[:1]
            out |= {(h, *t[1:]) for h in heads}
        return out

    def meant(self, value: str) -> str:
        text = fold(value)
        t = self._without_country(text)
        if not t:
            return ""
        return self._mention(t) or self._similar(t)

    def _without_country(self, text: str) -> list[str]:
        """The tokens before a trailing country: in brackets, or after a comma, slash or dash."""
        m = re.match(r"^(.*\S)\s*(?:\[([^\[\]]*)\]|\(([^()]*)\)|(?:,|/|\s-\s)\s*([^,/]*?))\s*[.*]*\s*$", text, re.S)
        if m and " ".join(tokens(m[2] or m[3] or m[4] or "")) in self.countries:
            text = m[1]
        return tokens(text)

    def _mention(self, t: list[str]) -> str:
        if not self.forms:
            return ""
        compact = "".join(t)
        starts, at = {}, 0
        for k, x in enumerate(t):
            starts[at] = k
            at += len(x)
        ends = {**{s: k for s, k in starts.items() if s}, at: len(t)}
        hits = []
        for end, f in self.auto.iter(compact):
            s, e = end + 1 - len(f), end + 1
            if s not in starts:
                continue
            if e in ends:
                rest = t[: starts[s]] + t[ends[e] :]
            else:
                # Inside a token only a word for the station may follow.
                k = max(i for p, i in starts.items() if p < e)
                tail = compact[e : next(p for p in sorted(ends) if p > e)]
                if tail not in self.kind:
                    continue
                rest = t[: starts[s]] + [tail] + t[k + 1 :]
            hits.append((-(e - s), s, e, f, rest))
        taken: list[tuple[int, int]] = []
        best = ""
        for size, s, e, f, rest in sorted(hits, key=lambda h: (h[0], h[1])):
            if any(s < b and a < e for a, b in taken):
                continue
            taken.append((s, e))
            if not best and -size >= 2:
                best = self._entry(self.forms[f], rest)
        return best

    def _near(self, run: str) -> Iterable[str]:
        """Forms that may be within their edits of a run: both lose letters until they are equal."""
        if (known := self.near.get(run)) is None:
            if len(self.near) >= _REMEMBERED:
                self.near.clear()
            known = self.near[run] = {f for x in deletions(run, allowed(len(run))) & self.index.keys() for f in self.index[x]}
        return known

    def _near_sets(self, t: Sequence[str]) -> Iterable[int]:
        """Numbers of the sets of which a rare token may match one of the tokens."""
        found: set[int] = set()
        for x in set(t):
            if (known := self.near_token.get(x)) is None:
                if len(self.near_token) >= _REMEMBERED:
                    self.near_token.clear()
                known = self.near_token[x] = {n for y in deletions(x, allowed(len(x))) & self.rare.keys() for n in self.rare[y]}
            found |= known
        return found

    def _overlap(self, form: tuple[str, ...], t: Sequence[str]) -> tuple[float, list[int]] | None:
        """(edits and missing letters, numbers of the tokens used) of a name's tokens among a value's, in any order; None below the least overlap."""
        used: list[int] = []
        cost, missing, letters = 0, 0, sum(map(len, form))
        for x in sorted(form, key=lambda x: (-len(x), x)):
            most = allowed(len(x))
            best = min(((edits(y, x, most), i) for i, y in enumerate(t) if i not in used and abs(len(y) - len(x)) <= most), default=(most + 1, -1))
            if best[0] > most:
                missing += len(x)
                if letters - missing < LEAST_OVERLAP * letters:
                    return None
            else:
                used.append(best[1])
                cost += best[0]
        return cost + missing, used

    def _similar(self, t: list[str]) -> str:
        """The name of the most similar tokens, by edits over length, few unknown tokens beside it; two places at equal rank are ambiguous."""
        found: dict[tuple[float, int], list[tuple[str, list[str]]]] = {}

        def add(cost: float, form: str, rest: list[str]) -> None:
            unknown = sum(x not in self.kind and x not in self.words.fillers for x in rest)
            found.setdefault((cost / len(form) + unknown, -len(form)), []).append((form, rest))

        for i in range(len(t)):
            run = ""
            for j in range(i, len(t)):
                run += t[j]
                if len(run) > self.most + self.longest_word:
                    break
                rest = t[:i] + t[j + 1 :]
                # A word for the station may be written together with the name.
                tails = [run[-n:] for n in self.tails if len(run) - n >= self.least and run[-n:] in self.kind]
                for name, beside in [(run, rest), *[(run[: -len(w)], [*rest, w]) for w in tails]]:
                    if self.least <= len(name) <= self.most:
                        for f in self._near(name):
                            d = edits(name, f, allowed(len(f)))
                            if d <= allowed(len(f)):
                                add(d, f, beside)
        for n in self._near_sets(t):
            form, compact = self.sets[n]
            if (hit := self._overlap(form, t)) is not None:
                add(hit[0], compact, [x for i, x in enumerate(t) if i not in hit[1]])
        for rank in sorted(found):
            answers = {a for f, rest in found[rank] if (a := self._entry(self.forms[f], rest))}
            if answers:
                return answers.pop() if len(answers) == 1 else ""
        return ""

    def _entry(self, targets: set[str], rest: list[str]) -> str:
        answers = {t[1:] if t[0] == "=" else self._of_place(t, rest) for t in targets}
        answers.discard("")
        return answers.pop() if len(answers) == 1 else ""

    def _of_place(self, place: str, rest: list[str]) -> str:
        entries = self.by_place[place]
        rest = [x for x in rest if x not in self.words.fillers]
        words = [*rest, "".join(rest)]
        for name, word, _ in entries:
            if word and word in words:
                return name
        kinds = {self.kind[w] for w in words if w in self.kind}
        if not kinds:
            kinds = {k for x in words if len(x) > 3 for k in self._near_kinds(x)}
        apart = kinds - {"main"}
        if apart:
            fit = [n for n, word, _ in entries if self.kind.get(word) in apart]
            return fit[0] if len(fit) == 1 else ""
        if len(entries) == 1:
            name, word, _ = entries[0]
            return name
        main = [n for n, word, _ in entries if self.kind.get(word, "main" if not word else "") == "main"]
        if len(main) > 1:
            main = [n for n, word, m in entries if n in main and (m if kinds else not word)] or main
        return main[0] if main else ""

    def _near_kinds(self, x: str) -> set[str]:
        """Kinds of the longer words within one edit."""
        if x not in self.kinds_near:
            if len(self.kinds_near) >= _REMEMBERED:
                self.kinds_near.clear()
            self.kinds_near[x] = {k for w, k in self.kind.items() if len(w) > 3 and edits(x, w, 1) <= 1}
        return self.kinds_near[x]


_BUILT: dict[str, tuple[Matcher, dict[str, str | None]]] = {}


def _matcher(key: str, lists) -> tuple[Matcher, dict[str, str | None]]:
    """One matcher a worker for each broadcast list, with the answers it has given."""
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = (Matcher(*lists), {})
    return _BUILT[key]


def gather(df: DataFrame, *columns: str) -> list[tuple]:
    """A list of proven size on the driver."""
    rows = df.select(*columns).limit(MOST_NAMES + 1).collect()
    if len(rows) > MOST_NAMES:
        raise ValueError(f"the canonical list has more than {MOST_NAMES} rows; it is held by every worker")
    if sum(len(x.encode("utf-8", "replace")) for r in rows for x in r if isinstance(x, str)) > MOST_NAME_BYTES:
        raise ValueError(f"the canonical list has more than {MOST_NAME_BYTES} bytes; it is held by every worker")
    return [tuple(r) for r in rows]


def station_lists(stations: DataFrame, cities: DataFrame, zones: DataFrame) -> tuple[list, list, list]:
    """The three lists of a Matcher from stations, cities (with alternate names) and country names."""
    towns = gather(cities, "name", "ascii_name", "alternate_names", "country")
    known = {n for n, *_ in towns if n}

    def place(name: str) -> str:
        words = name.split(" ")
        return next((p for k in range(len(words), 0, -1) if (p := " ".join(words[:k])) in known), "")

    named = gather(stations, "name", "is_main_station", "country")
    entries = [(n, place(n), bool(m)) for n, m, _ in named if n and n.strip()]
    aliases = [(n, a.strip()) for n, ascii_name, alternates, _ in towns if n for a in [n, ascii_name or "", *(alternates or "").split(",")] if a.strip()]
    countries = {c for *_, c in named if c} | {x for r in gather(zones, "iso_country", "country_name") for x in r if x}
    return entries, aliases, sorted(countries)


def match_values(df: DataFrame, value: str, lists: tuple[list, list, list], out: str = "station_name") -> DataFrame:
    """``df`` with ``out``: the entry meant by ``value``, "" if none; null where the value is an entry itself.

    The list is broadcast (its size is checked by ``gather``).  Equal values of a batch are
    answered once and workers remember answers, so no shuffle is needed and hot values cost little.
    A column of ``df`` named ``out`` is replaced.
    """
    df = df.drop(out)
    shared = df.sparkSession.sparkContext.broadcast(lists)
    key = uuid.uuid4().hex
    head, at = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), df.columns.index(value)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, known = _matcher(key, shared.value)

        def answer(v: str | None) -> str | None:
            if v is None:
                return None
            if v not in known:
                if len(known) >= _REMEMBERED:
                    known.clear()
                known[v] = None if v in m.names else m.meant(v)
            return known[v]

        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([answer(v) for v in b.column(at).to_pylist()], pa.string())], names=[*b.schema.names, out])

    return df.mapInArrow(run, f"{head}, `{out}` string")


def meant_values(df: DataFrame, value: str, lists: tuple[list, list, list], out: str = "station_name") -> DataFrame:
    """The rows of ``df`` whose value is stated and no entry itself, with the entry meant or "".

    Entries are dropped by a join with the broadcast list before anything leaves the JVM, and
    every distinct value is answered once: the rows left are written to the shared folder,
    their distinct values (combined before the shuffle) answered, and the answers joined back,
    by broadcast if counted small, else by a shuffle whose hot values adaptive execution splits.
    A column of ``df`` named ``out`` is replaced; other columns stay, whatever their names.
    """
    df = df.drop(out)
    names = df.sparkSession.createDataFrame([(e[0],) for e in lists[0]], f"`{value}` string").distinct()
    rest = cut(df.where(F.col(value).isNotNull()).join(F.broadcast(names), value, "left_anti"))
    answers = cut(match_values(spread(rest.select(value).distinct(), value), value, lists, out))
    return rest.join(small(answers), value)


def spread(df: DataFrame, column: str) -> DataFrame:
    """``df`` in two parts a core: few bytes but much work a row.

    The parts are by a hash of the column and not by the column itself, by which the rows may
    be parted already: that exchange would be left out and adaptive execution merge the parts.
    """
    return df.repartition(2 * df.sparkSession.sparkContext.defaultParallelism, F.xxhash64(F.col(column), F.lit(3)))
