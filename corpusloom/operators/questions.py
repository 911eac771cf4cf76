"""Questions as search terms: words of alphabetic scripts, and pieces of scripts without blanks between words."""

from __future__ import annotations

import re

from .postings import CJK

#: Characters between terms of a question (those inside words, such as - . +, are not among them).
SEPARATORS = " \t\r\n ，、。！？；：「」『』【】（）《》〈〉“”‘’—…·～％＊＂＇＃＄＆（）－＝／＼｜!?\"'(),:;<>[]{}#$%&*~`|^@/"
#: Single function characters.
FUNCTION = "的了是在和与及或之而就也被把对从很这那其们为吗呢吧啊于以会让"
#: Further characters that are stripped from the ends of a piece.
EDGES = FUNCTION + "人使系等"
#: Frames of questions and conjunctions.
FRAMES = (
    "为什么", "为何", "什么是", "是什么", "什么样", "有什么", "怎么样", "怎样", "怎么",
    "哪些", "哪个", "哪里", "何处", "何时", "多少", "是否", "能否",
    "可以", "而且", "并且", "或者", "但是", "因为", "所以", "如果", "虽然", "然后",
    "以及", "之间", "来自", "属于", "有一个", "一个", "这个", "那个", "如何",
)
#: English words that carry no search intent.
QUIET = set(
    "a an the is are was were be been being do does did have has had of to in on at by for with about into from as and or but if so not no yes "
    "can will would should could may might must it its this that these those they them their we our you your i he she his her who whom whose which what "
    "when where why how than then there here very more most some any each other such also just like between".split()
)
LEAST, MOST = 2, 6
_SEGMENT = re.compile(f"[^{re.escape(SEPARATORS)}]+")
_RUN = re.compile(f"([{CJK}]+)|[^{CJK}]+")
_BOUNDARY = re.compile(f"(.{{{LEAST},}}?)[{FUNCTION}](?=.{{{LEAST}}})")
_GAP = "\n"


def _pieces(run: str) -> list[str]:
    """A run of ideographs without frames, cut at function characters that leave LEAST characters on both sides."""
    for frame in sorted(FRAMES, key=len, reverse=True):
        cut = run.replace(frame, _GAP)
        run = cut if cut.strip(_GAP) else run  # what is nothing but a frame stays
    out = []
    for piece in filter(None, run.split(_GAP)):
        at = 0
        while found := _BOUNDARY.match(piece, at):
            out.append(found.group(1))
            at = found.end()
        out.append(piece[at:])
    return [p for p in out if len(p) >= LEAST]


def _bare(piece: str) -> str:
    """The piece without EDGES at its ends, front first, as long as LEAST characters stay."""
    front = len(piece) - len(piece.lstrip(EDGES))
    piece = piece[min(front, len(piece) - LEAST) :]
    back = len(piece) - len(piece.rstrip(EDGES))
    return piece[: len(piece) - min(back, len(piece) - LEAST)]


def _forms(piece: str) -> list[str]:
    """The piece and its bare form; of a short piece only where nothing but function characters went."""
    bare = _bare(piece)
    gone = piece.replace(bare, "", 1)
    return [piece, bare] if bare != piece and (len(piece) > 4 or not gone.strip(FUNCTION)) else [piece]


def terms(question: str, most: int = MOST) -> list[str]:
    """At most `most` terms of a question, the longest of each blank-separated segment first, no repeats.

    Ideographs and other characters are kept apart. A run of up to three ideographs is a term as it is (two or more), a
    longer one is cut (see _pieces) and gives whole and bare forms. Other runs need two characters, a letter or digit,
    and not to be QUIET; their case doesn't tell terms apart.
    """
    out: dict[str, str] = {}
    for segment in _SEGMENT.findall(question):
        found: list[str] = []
        for m in _RUN.finditer(segment):
            run = m.group()
            if len(run) < LEAST:
                continue
            if m.group(1):
                found += [run] if len(run) < 4 else [f for p in _pieces(run) for f in _forms(p)]
            elif run.lower() not in QUIET and any(map(str.isalnum, run)):
                found.append(run)
        for t in sorted(found, key=len, reverse=True):
            out.setdefault(t if re.match(f"[{CJK}]", t) else t.lower(), t)
    return list(out.values())[:most]


def windows(found: list[str], sizes: tuple[int, ...] = (4, 3), most: int = 6) -> list[str]:
    """Windows of long ideograph terms, for questions that find nothing: by place, the wider first, no repeats."""
    long = [t for t in found if len(t) > 4 and re.match(f"[{CJK}]", t)]
    every = (t[i : i + n] for t in long for i in range(len(t) - min(sizes) + 1) for n in sizes if i + n <= len(t))
    return list(dict.fromkeys(w for w in every if w not in found))[:most]
