"""Members of declarations, from one lexer with a bracket stack: comments and literals are blanked, brackets are paired in
one pass, and a body is cut at the separators of its own depth. Everything stays inside the row of its file or class.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.extract.structure import _NO_CODE, _blank

_PAIRS = {"}": "{", ")": "(", "]": "[", ">": "<"}
_SIGNS = re.compile(r"=>|->|<-|[{}()\[\]<>;,\n]")
# A member goes on over a line end behind or before one of these.
_OPEN_END, _OPEN_START = tuple(":|&=?."), tuple("|&:?=.")
_ASSIGN = re.compile(r"(?<![=!<>:+\-*/%&|^@])=(?!=)|[()\[\]{}]")


def _without_comments(text: str, language: str) -> str:
    kind = "python" if language == "python" else "brace"
    return _NO_CODE[kind].sub(lambda m: re.sub(r"[^\n]", " ", m[0]) if m[0][0] in "#/" else m[0], text)


def _frames(bare: str, angles: bool) -> tuple[list[list], list[int]]:
    """Frames [open, close, bracket, parent's frame or None, separators] by place, and the places of ``;`` and ``}``.

    A closing bracket ends the innermost frame of its kind; a ``<`` that nothing closed is an operator and leaves its
    separators to the frame around it. A frame that never closes has the close None.
    """
    frames, stack, ends = [], [], []

    def drop() -> None:
        lost = stack.pop()
        if stack:
            stack[-1][4].extend(lost[4])

    for m in _SIGNS.finditer(bare):
        at, sign = m.start(), m[0]
        if sign in ";}":
            ends.append(at)
        if len(sign) > 1 or (sign in "<>" and not angles):
            continue
        if sign in "{([<":
            frame = [at, None, sign, stack[-1] if stack else None, []]
            frames.append(frame)
            stack.append(frame)
        elif sign in _PAIRS:
            want = _PAIRS[sign]
            if sign == ">":
                if stack and stack[-1][2] == "<":
                    stack.pop()[1] = at
                continue
            depth = len(stack) - 1
            while depth >= 0 and stack[depth][2] != want and (sign == "}" or stack[depth][2] == "<"):
                depth -= 1
            if depth < 0 or stack[depth][2] != want:
                continue
            while len(stack) > depth + 1:
                drop()
            stack.pop()[1] = at
        elif stack:
            stack[-1][4].append(at)
    return frames, ends


def _block_after(at: int, frames: list[list], opens: list[int], ends: list[int]) -> list | None:
    """The brace that a head ending at ``at`` opens: not one inside its type parameters, and before any ``;`` or ``}``."""
    k, reach = bisect_left(opens, at), at
    while k < len(frames):
        frame = frames[k]
        stop = bisect_left(ends, reach)
        if stop < len(ends) and ends[stop] < frame[0]:
            return None
        if frame[2] == "{":
            return frame
        if frame[1] is None:
            return None
        reach, k = frame[1], bisect_left(opens, frame[1], k + 1)
    return None


def block_members(text: str, head: re.Pattern, separators: str, angles: bool) -> list[tuple[str, list[str]]]:
    """(name, members) of every closed block whose head matches; members in order, without comments, never empty."""
    bare, plain = _blank(text, "brace"), _without_comments(text, "brace")
    frames, ends = _frames(bare, angles)
    opens, out = [f[0] for f in frames], []
    for m in head.finditer(bare):
        frame = _block_after(m.end(), frames, opens, ends)
        if frame is None or frame[1] is None:
            continue
        members, begin, glued = [], frame[0] + 1, False
        for at in [*(s for s in sorted(frame[4]) if bare[s] in separators), frame[1]]:
            piece, inner = plain[begin:at].strip(), bare[begin:at].strip()
            line_before, begin = begin > 0 and bare[begin - 1] == "\n", at + 1
            if piece:
                if members and line_before and (glued or inner.startswith(_OPEN_START)):
                    members[-1] += " " + piece
                else:
                    members.append(piece)
                glued = inner.endswith(_OPEN_END)
        out.append((m[1], members))
    return out


def class_statements(text: str) -> list[tuple[str, str | None]]:
    """(target, value) of the statements of a Python class body at its own indentation; value: behind the first plain ``=``.

    A statement goes on inside brackets, literals and behind a backslash. Bodies of methods and inner classes lie deeper.
    """
    bare, plain = _blank(text, "python"), _without_comments(text, "python")
    inside, at, depth, logical = set(), 0, 0, []
    for m in _NO_CODE["python"].finditer(text):
        inside.update(i for i in range(m.start() + 1, m.end()) if text[i] == "\n")
    carried = False
    for line in bare.split("\n"):
        if depth > 0 or carried:
            logical[-1][2] = at + len(line)
        elif line.strip():
            logical.append([len(line) - len(line.lstrip()), at, at + len(line)])
        depth = max(0, depth + sum(map(line.count, "([{")) - sum(map(line.count, ")]}")))
        at += len(line) + 1
        carried = bool(logical) and (line.rstrip().endswith("\\") or at - 1 in inside)
    out = []
    for indent, begin, end in logical[1:]:
        if indent != logical[1][0]:
            continue
        depth, cut = 0, None
        for m in _ASSIGN.finditer(bare, begin, end):
            depth += (m[0] in "([{") - (m[0] in ")]}")
            if m[0] == "=" and depth == 0:
                cut = m.start()
                break
        out.append((plain[begin:end].strip(), None) if cut is None else (plain[begin:cut].strip(), plain[cut + 1:end].strip()))
    return out


def blocks(content: str, head: str, separators: str, angles: bool) -> Column:
    """``array<struct<name, members>>`` of the blocks of a text. Null texts have none."""
    pattern = re.compile(head)

    @F.pandas_udf("array<struct<name string, members array<string>>>")
    def cut(text: pd.Series) -> pd.Series:
        return text.map(lambda t: [] if t is None else [
            {"name": n, "members": m} for n, m in block_members(t, pattern, separators, angles)])

    return cut(content)


@F.pandas_udf(T.ArrayType(T.StructType().add("target", "string").add("value", "string")))
def statements(text: pd.Series) -> pd.Series:
    """Statements of a class text at the depth of its body."""
    return text.map(lambda t: [] if t is None else [{"target": a, "value": b} for a, b in class_statements(t)])
