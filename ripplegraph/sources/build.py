"""Build constraints of a Go file: its name, `//go:build` and `// +build` lines, and cgo."""

from __future__ import annotations

import re

# The systems and machines that file names and tags go by.
SYSTEMS = "aix android darwin dragonfly freebsd illumos ios js linux netbsd openbsd plan9 solaris wasip1 windows".split()
MACHINES = "386 amd64 arm arm64 loong64 mips mips64 mips64le mipsle ppc64 ppc64le riscv64 s390x wasm".split()
UNIX = "aix android darwin dragonfly freebsd illumos ios linux netbsd openbsd solaris".split()
_TOKEN = re.compile(r"\s*(\|\||&&|!|\(|\)|[\w.]+)")


def tags_of(goos: str, goarch: str, cgo: bool, tags: tuple[str, ...] = (), release: int = 30) -> set[str]:
    out = {goos, goarch, "gc", *tags, *(f"go1.{i}" for i in range(1, release + 1))}
    return out | ({"unix"} if goos in UNIX else set()) | ({"cgo"} if cgo else set())


def holds(expression: str, tags: set[str]) -> bool:
    """The value of a `//go:build` expression; one that can't be read holds, as a tolerant load keeps the file."""
    words, at = [], 0
    while at < len(expression.rstrip()):
        m = _TOKEN.match(expression, at)
        if not m:
            return True
        words.append(m[1])
        at = m.end()

    def either(i: int) -> tuple[bool, int]:
        value, i = both(i)
        while i < len(words) and words[i] == "||":
            more, i = both(i + 1)
            value = value or more
        return value, i

    def both(i: int) -> tuple[bool, int]:
        value, i = one(i)
        while i < len(words) and words[i] == "&&":
            more, i = one(i + 1)
            value = value and more
        return value, i

    def one(i: int) -> tuple[bool, int]:
        if words[i] == "!":
            value, i = one(i + 1)
            return not value, i
        if words[i] == "(":
            value, i = either(i + 1)
            return value, i + 1
        return words[i] in tags, i + 1

    try:
        value, end = either(0)
    except IndexError:
        return True
    return value if end == len(words) else True


def in_build(path: str, text: str, tags: set[str]) -> bool:
    """Whether a file belongs to the build with these tags."""
    words = path.rsplit("/", 1)[-1].removesuffix(".go").split("_")[1:]
    if words and words[-1] in MACHINES:
        if words.pop() not in tags:
            return False
    if words and words[-1] in SYSTEMS and words[-1] not in tags:
        return False
    head = re.split(r"(?m)^package\s", text, maxsplit=1)[0]
    if m := re.search(r"(?m)^//go:build\s+(.+)$", head):
        if not holds(m[1], tags):
            return False
    else:
        for line in re.findall(r"(?m)^//\s*\+build\s+(.+)$", head):
            if not any(all((t[1:] not in tags) if t.startswith("!") else t in tags for t in option.split(",")) for option in line.split()):
                return False
    return "cgo" in tags or not re.search(r'(?m)^\s*import\s+(?:\(\s*)?"C"', text)
