"""Column functions on question and name texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Particles that may follow a name.
PARTICLES = ["은", "는", "이", "가", "을", "를", "와", "과", "의", "에", "에서", "에게", "로", "으로", "도", "만", "요", "야", "이란", "란", "이라는", "라는", "인데", "부터", "까지"]
#: Bracket pairs around a title.
BRACKETS = [("《", "》"), ("〈", "〉"), ("「", "」"), ("『", "』"), ("“", "”"), ("‘", "’"), ('"', '"'), ("'", "'")]
#: Endings of verbs that no name has.
VERB_TAILS = ["면서", "지만", "는데", "다가", "거나", "려고", "도록", "하는", "하고", "하며", "되는", "되고", "어서", "아서", "았다", "었다", "한다", "인가", "일까", "인지", "고", "며"]
#: Whether a question asks for a role.
ASKS_CHARACTER = r"(?<![지사구통번영])역할?(을|은|는|이|가|의|으로)?($|[\s?!.,])|연기|분한|맡은|맡았|열연|배역"
#: Words that are neither roles nor names.
NOT_A_CHARACTER = [
    "영화", "배우", "누구", "누구인", "누구인가", "누구인가요", "무엇", "무엇인", "역을", "역할", "역할을", "맡은", "맡았", "연기", "연기한", "출연", "출연한",
    "주연", "조연", "악역", "감독", "작품", "제목", "이름", "알려", "알려줘", "어떻게", "어떤", "무슨", "시리즈", "나오는", "나온",
    "이전", "이후", "이터", "그리고", "그런", "모두", "함께", "같이", "자주", "한국", "한국형", "좀비", "액션", "코미디", "스릴러", "드라마", "로맨스",
    "최근", "요즘", "올해", "당시", "처음", "마지막", "다른", "무엇을",
]
#: Phrases around what a question searches for.
QUERY_FILLER = "(알려줘|알려주세요|추천해줘|추천|말해줘|보여줘|찾아줘|무엇인가요|무엇인지|뭐야|뭔가요|어떤거지|어떤가요|있나요|있어|없어)|(영화|작품|이야기|내용|줄거리|관련된|관련|대한|대해|에서|나오는|나온|있는|같은)"
#: Words and endings that are no condition of a question.
TERM_NOISE = [
    "영화", "작품", "이야기", "내용", "줄거리", "사건", "관련", "관련된", "대한", "대해", "알려줘", "알려", "추천", "뭐야", "뭔가요", "무엇", "어떤", "어떤거지", "누구", "있는",
    "나오는", "나온", "출연", "출연한", "주연", "조연", "연기", "연기한", "맡은", "등장", "감독", "배우", "다룬", "그린", "중에", "중인", "정도", "같은", "함께",
    "무엇인가요", "누구인가요", "언제인가요", "어디인가요", "제목", "국내", "개봉", "개봉일", "연도", "한국", "역대", "흥행", "상위권", "박스오피스", "기록한",
]
TERM_ENDINGS = "(에서|으로|하는|되는|이라는|라는|에게|까지|부터|보다|처럼|이나|거나|에는|의|을|를|이|가|은|는|와|과|로|도|만|중)$"
#: Honorifics after a role's name.
ROLE_TITLES = ["대왕", "장군", "왕자", "공주", "스님", "선생", "박사", "교수", "여사", "대통령", "왕비", "황제"]
#: Initials, vowels and finals of Hangul syllables in Roman letters.
INITIALS = ["g", "kk", "n", "d", "tt", "r", "m", "b", "pp", "s", "ss", "", "j", "jj", "ch", "k", "t", "p", "h"]
VOWELS = ["a", "ae", "ya", "yae", "eo", "e", "yeo", "ye", "o", "wa", "wae", "oe", "yo", "u", "wo", "we", "wi", "yu", "eu", "ui", "i"]
FINALS = ["", "k", "k", "ks", "n", "nj", "nh", "t", "l", "lk", "lm", "lb", "ls", "lt", "lp", "lh", "m", "p", "ps", "t", "t", "ng", "t", "t", "k", "t", "p", "t"]
#: Replacements that make spellings of a syllable alike, in this order.
ALIKE = [("[^a-z가-힣]", ""), ("ch", "j"), ("sh", "s"), ("h", ""), ("ee", "i"), ("ui", "i"), ("oo", "u"), ("wu", "u"), ("ou", "u"), ("eo", "u"), ("eu", "u"), ("ae", "e"), ("oe", "o"), ("k", "g"), ("t", "d"), ("p", "b"), ("c", "g"), ("^l(?=i)", ""), ("^yi$", "i")]


def norm(s: Column) -> Column:
    """Without white space, in lower case."""
    return F.lower(F.regexp_replace(s, r"\s+", ""))


def key(s: Column) -> Column:
    """Without middle dots, full stops and white space, in lower case."""
    return F.lower(F.regexp_replace(s, r"[·・.\s]", ""))


def main_title(title: Column) -> Column:
    """What stands before a subtitle, if it is shorter and of two characters at least; else null."""
    head = F.trim(F.element_at(F.split(title, r"[:：]| - "), 1))
    return F.when((F.length(head) >= 2) & (F.length(head) < F.length(title)), head)


def question_tokens(q: Column) -> Column:
    """White-space tokens in lower case, without punctuation at their front."""
    cleaned = F.transform(F.split(F.lower(F.trim(q)), r"\s+"), lambda t: F.regexp_replace(t, "^[^0-9A-Za-z가-힣]+", ""))
    return F.filter(cleaned, lambda t: t != "")


def token_suffixes(q: Column) -> Column:
    """The tokens joined from each of them on: where a name may begin."""
    tokens = question_tokens(q)
    return F.transform(tokens, lambda _, i: F.array_join(F.slice(tokens, i + 1, F.size(tokens)), ""))


def mentions(q: Column, name: Column) -> Column:
    """Whether a name of two characters at least begins at one of the question's tokens, white space ignored."""
    n = norm(name)
    return (F.length(n) >= 2) & F.exists(token_suffixes(q), lambda s: s.startswith(n))


def whole_keys(q: Column) -> Column:
    """What a question says as a whole word: its tokens without any punctuation, as they are and without a particle."""
    bare = F.transform(F.split(q, r"\s+"), lambda t: F.lower(F.regexp_replace(t, "[^0-9A-Za-z가-힣]+", "")))
    cut = lambda t: F.array(t, *(F.when(t.endswith(p), F.substring(t, F.lit(1), F.length(t) - len(p))) for p in PARTICLES))
    return F.array_distinct(F.filter(F.flatten(F.transform(bare, cut)), lambda k: k.isNotNull() & (F.length(k) >= 2)))


def mentions_whole(q: Column, name: Column) -> Column:
    """Whether a token without punctuation is the name (of two characters at least), with a particle or not."""
    return F.array_contains(whole_keys(q), norm(name))


def mentions_name(q: Column, name: Column) -> Column:
    """Short names as whole words, longer ones by their beginning."""
    return F.when(F.length(norm(name)) <= 2, mentions_whole(q, name)).otherwise(mentions(q, name))


def bracketed(q: Column, title: Column) -> Column:
    """Whether the title stands in brackets or quotes."""
    return reduce(Column.__or__, (q.contains(F.concat(F.lit(a), title, F.lit(b))) for a, b in BRACKETS))


def strip_role_title(word: Column) -> Column:
    """The word before each honorific that stands in it from the third character on."""
    cuts = F.array(*(F.when(F.instr(word, t) >= 3, F.substring(word, F.lit(1), F.instr(word, t) - 1)) for t in ROLE_TITLES))
    return F.filter(cuts, lambda x: x.isNotNull())


def is_conjugated(word: Column) -> Column:
    """Whether a word of three characters at least ends like a verb."""
    return (F.length(word) >= 3) & word.rlike(f"({'|'.join(VERB_TAILS)})$")


def role_candidates(q: Column, honorifics: bool = True) -> Column:
    """What may be a role's name: the first Hangul run of each token, also without its last one or two syllables, or before an honorific."""
    runs = F.filter(F.transform(F.split(q, r"\s+"), lambda t: F.regexp_extract(t, "[가-힣]{2,7}", 0)), lambda w: (w != "") & ~is_conjugated(w))

    def forms(w: Column) -> Column:
        cut = F.array(w, *(F.substring(w, F.lit(1), F.length(w) - n) for n in (1, 2)))
        return F.concat(cut, strip_role_title(w)) if honorifics else cut

    return F.array_distinct(F.filter(F.flatten(F.transform(runs, forms)), lambda c: (F.length(c) >= 2) & ~c.isin(*NOT_A_CHARACTER)))


def lean_query(q: Column) -> Column:
    """A question without the phrases around what it searches for; as it is, if nothing else is left."""
    lean = F.trim(F.regexp_replace(F.regexp_replace(q, QUERY_FILLER, " "), r"\s+", " "))
    return F.when(F.length(F.regexp_replace(lean, "[^가-힣0-9A-Za-z]", "")) >= 2, lean).otherwise(q)


def query_terms(q: Column, most: int = 5) -> Column:
    """The conditions in a question: its Hangul words without endings, without phrases that are none."""
    words = F.transform(F.regexp_extract_all(q, F.lit("[가-힣]{2,}"), 0), lambda w: F.regexp_replace(w, TERM_ENDINGS, ""))
    return F.slice(F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 2) & ~w.isin(*TERM_NOISE))), 1, most)


def long_date(date: Column) -> Column:
    """`1999-03-07` as `1999년 3월 7일`; anything else as it is."""
    part = lambda i: F.regexp_extract(date, r"^(\d{4})-(\d{2})-(\d{2})$", i)
    return F.when(part(1) == "", date).otherwise(F.concat(part(1), F.lit("년 "), part(2).cast("int"), F.lit("월 "), part(3).cast("int"), F.lit("일")))


def last_index(s: Column, part: str) -> Column:
    """Where a part stands last (from 0), -1 if nowhere."""
    at = F.instr(F.reverse(s), part[::-1])
    return F.when(at > 0, F.length(s) - at - len(part) + 1).otherwise(-1)


def summary(body: Column, size: int = 460, least: int = 120) -> Column:
    """The first `size` characters, up to the last sentence end that lies beyond `least`, white space squeezed."""
    head = F.substring(body, 1, size)
    end = F.greatest(*(last_index(head, e) for e in (". ", "다.", "다\n")))
    return F.trim(F.regexp_replace(F.when(end > least, F.substring(head, F.lit(1), end + 2)).otherwise(head), r"\s+", " "))


def tokenize(s: Column) -> Column:
    """Search tokens: runs of Latin letters and digits in lower case; pairs of neighbouring syllables of Hangul runs."""
    runs = F.regexp_extract_all(s, F.lit(r"([0-9A-Za-z]+|[가-힣]+)"), 1)

    def split(run: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(run) - 1, F.lit(1))), lambda i: F.substring(run, i, F.lit(2)))
        return F.when(run.rlike("^[가-힣]"), pairs).otherwise(F.array(F.lower(run)))

    return F.flatten(F.transform(runs, split))


def syllables(s: Column) -> Column:
    """Each Hangul syllable in Roman letters, other characters as they are."""
    tables = [F.array(*map(F.lit, t)) for t in (INITIALS, VOWELS, FINALS)]

    def one(ch: Column) -> Column:
        code = F.ascii(ch) - 0xAC00
        parts = (F.floor(code / 588), F.floor(F.pmod(code, F.lit(588)) / 28), F.pmod(code, F.lit(28)))
        spelt = F.concat(*(F.get(t, p.cast("int")) for t, p in zip(tables, parts)))
        return F.when((code >= 0) & (code <= 11171), spelt).otherwise(ch)

    return F.transform(F.filter(F.split(s, ""), lambda c: c != ""), one)


def alike(part: Column) -> Column:
    """One part of a name in a form in which spellings of it agree."""
    return reduce(lambda c, r: F.regexp_replace(c, *r), ALIKE, F.lower(part))


def squash(s: Column) -> Column:
    """Runs of one character as one."""
    return F.regexp_replace(s, r"(.)\1+", "$1")


def loose(s: Column) -> Column:
    return squash(alike(s))


def hangul_key(name: Column) -> Column:
    """What a Hangul name is compared by: its syllables made alike one by one, then joined."""
    return squash(F.array_join(F.transform(syllables(name), alike), ""))


def roman_parts(name: Column) -> Column:
    parts = F.transform(F.filter(F.split(name, r"[\s\-·/,()]+"), lambda p: p != ""), alike)
    return F.filter(parts, lambda p: p != "")


def name_matches(korean: Column, roman: Column) -> Column:
    """Whether a Hangul name is the Roman one: contained as it is, or equal to a run of its parts.

    A run is tried until, unsquashed, it is longer than the Hangul name's key.
    """
    target, parts = hangul_key(korean), roman_parts(roman)
    runs = F.flatten(F.transform(parts, lambda _, i: F.transform(F.sequence(F.lit(1), F.size(parts) - i), lambda n: F.struct(F.array_join(F.slice(parts, i + 1, n), "").alias("run"), F.array_join(F.slice(parts, i + 1, n - 1), "").alias("before")))))
    found = F.exists(runs, lambda r: (squash(r["run"]) == target) & (F.length(r["before"]) <= F.length(target)))
    return F.when((F.coalesce(F.length(korean), F.lit(0)) == 0) | (F.coalesce(F.length(roman), F.lit(0)) == 0), F.lit(False)).when(roman.contains(korean), F.lit(True)).when(F.length(target) < 3, F.lit(False)).otherwise(found)


def first_hit(q: Column, words: list[str]) -> Column:
    """The first of the words that a question holds, white space ignored; null if none."""
    bare = F.regexp_replace(q, r"\s+", "")
    return F.get(F.filter(F.array(*map(F.lit, words)), lambda w: bare.contains(F.regexp_replace(w, r"\s+", ""))), F.lit(0))
