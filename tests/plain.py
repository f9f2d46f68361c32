"""Chunking written out in plain Python, to hold the column expressions against."""

from __future__ import annotations

import re

WS = "\t\n\x0b\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
W = f"[{WS}]"


def tokens(s: str) -> list[str]:
    return [x for x in re.split(f"{W}+", s) if x]


def sections(text: str) -> list[tuple[list[str], str]]:
    out, path, body = [], None, []

    def close():
        joined = "\n".join(body).strip(WS)
        if path is not None and joined:
            out.append((path, joined))

    for line in text.split("\n"):
        m = re.match(rf"^(#{{1,6}}){W}+([^\n\r\u2028\u2029]+?){W}*\Z", line)
        if m:
            close()
            depth = len(m[1])
            path, body = ((path or [])[: depth - 1] + [""] * 6)[: depth - 1] + [m[2]], []
        else:
            body.append(line)
    close()
    return out


def merged(found, least):
    out, held = [], None
    for path, text in found:
        now = (held[0], held[1] + "\n\n" + text) if held else (path, text)
        if len(tokens(text)) < least:
            held = now
        else:
            out.append(now)
            held = None
    return out + ([held] if held else [])


def packed(units, most):
    out, held, n = [], [], 0
    for u in filter(None, (u.strip(WS) for u in units)):
        k = len(tokens(u))
        if held and n + k > most:
            out.append(" ".join(held))
            held, n = [], 0
        held.append(u)
        n += k
    return out + ([" ".join(held)] if held else [])


def lines_packed(text, most):
    units, run = [], []
    for line in [*text.split("\n"), None]:
        is_table = line is not None and line.lstrip(WS).startswith("|")
        if run and not is_table:
            units.append(("\n".join(run), True))
            run = []
        if is_table:
            run.append(line)
        elif line is not None:
            units.append((line, False))
    out, held, n = [], [], 0
    for u, is_table in units:
        t = tokens(u)
        if n and n + len(t) > most:
            out.append("\n".join(held).strip(WS))
            held, n = [], 0
        if not is_table and len(t) > most:
            out += [" ".join(t[i : i + most]) for i in range(0, len(t), most)]
            held, n = [], 0
        else:
            held.append(u)
            n += len(t)
    return out + (["\n".join(held).strip(WS)] if n else [])


def split(text, most, overlap=0, overflow="paragraph"):
    if len(tokens(text)) <= most:
        return [text]
    rungs = ["paragraph", "sentence", "token"]
    for rung in rungs[rungs.index(overflow) :]:
        if rung == "token":
            pieces = lines_packed(text, most)
        else:
            pieces = packed(re.split(rf"\n{W}*\n" if rung == "paragraph" else rf"(?<=[.!?]){W}+", text), most)
            if any(len(tokens(p)) > most for p in pieces):
                continue
        return [p if i == 0 or overlap <= 0 else " ".join(tokens(pieces[i - 1])[-overlap:]) + " " + p for i, p in enumerate(pieces)]
    raise AssertionError


def chunks(text, least, most, overlap, overflow="paragraph"):
    return [(path, p) for path, body in merged(sections(text), least) for p in split(body, most, overlap, overflow)]
