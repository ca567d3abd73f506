"""The common licences in full, from `licences/`, in the forms in which they are found: with and without title lines and appendix."""

from __future__ import annotations

import functools
import re
from itertools import product
from pathlib import Path

from .licence_scan import KNOWN

FOLDER = Path(__file__).with_name("licences")
#: Where a file's text begins after its title lines, and titles besides the file's own.
_GNU = r"^ *Copyright \(C\)"
STARTS = {
    "Apache-2.0": r"^ *TERMS AND CONDITIONS FOR", "Artistic-1.0-Perl": r"^\s*Preamble", "BSL-1.0": r"^Permission is", "CC0-1.0": r"^ *CREATIVE COMMONS CORPORATION", "MPL-1.1": r"^1\. Definitions", "MPL-2.0": r"^1\. Definitions",
    "GFDL-1.2": _GNU, "GFDL-1.3": _GNU, "GPL-1.0": _GNU, "GPL-2.0": _GNU, "GPL-3.0": _GNU, "LGPL-2.0": _GNU, "LGPL-2.1": _GNU, "LGPL-3.0": _GNU,
}
TITLES = {
    "0BSD": ("0BSD", "0BSD License", "BSD Zero Clause License", "Zero-Clause BSD", "BSD Zero Clause License (0BSD)"), "Apache-2.0": ("Apache License\nVersion 2.0, January 2004",), "Artistic-1.0-Perl": ("The Artistic License", "Artistic License"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License", "BSD-2-Clause", "The 2-Clause BSD License", "Simplified BSD License", "BSD 2-Clause \"Simplified\" License", "BSD License", "The BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License", "BSD-3-Clause", "The 3-Clause BSD License", "New BSD License", "The New BSD License", "Modified BSD License", "Revised BSD License", "BSD 3-Clause \"New\" or \"Revised\" License", "BSD License", "The BSD License"),
    "BSL-1.0": ("Boost Software License 1.0",), "CC0-1.0": ("CC0 1.0 Universal",), "ISC": ("ISC License", "The ISC License", "ISC License (ISC)", "ISC"), "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)", "MIT", "Expat License"),
    "MPL-2.0": ("Mozilla Public License, version 2.0",), "Unlicense": ("The Unlicense", "Unlicense"), "Zlib": ("zlib License", "The zlib License", "zlib/libpng License", "The zlib/libpng License"),
}
TITLES["BSD-3-Clause-Regents"] = TITLES["BSD-3-Clause"]
#: Wordings of one licence; each pattern's choices are combined with all others'. The empty choice leaves what is there.
_WRITE_TO = r"write to the Free\s+Software\s+Foundation, Inc.,\s+51 Franklin[^>]*?USA"
_FRANKLIN = r"51 Franklin St\w*, Fifth Floor,\s+Boston, MA\s+02110-1301,?\s+USA"
WORDINGS = (
    (r"(?m)^\s*(?:\d\.|\*)(?=\s+(?:Redistributions|Neither))", ("", "1. ", " ")), (r"COPYRIGHT\s+(?:HOLDER|OWNER)(?= OR|\s+OR)", ("", "COPYRIGHT HOLDER", "COPYRIGHT OWNER")), (r"and this permission notice(?= shall)", ("", "and this permission notice (including the next paragraph)")),
    (r"copy, modify, and/or distribute", ("", "copy, modify, and distribute")), (_WRITE_TO, ("", "see <https://www.gnu.org/licenses/>")), (_FRANKLIN, ("", "59 Temple Place, Suite 330, Boston, MA 02111-1307 USA", "675 Mass Ave, Cambridge, MA 02139, USA", "<https://fsf.org/>")), (r"Ty Coon", ("", "Moe Ghoul")),
    (r"https?://", ("", "http://", "https://")),
)


def _reworded(text: str) -> set[str]:
    out = {text}
    for pattern, choices in WORDINGS:
        found = re.search(pattern, text)
        if found and pattern.startswith(r"(?m)^\s*(?:\d"):
            numbers = iter("123456789")
            out |= {re.sub(pattern, " ", t) for t in out} | {re.sub(pattern, lambda m, n=numbers: f"\n{next(n)}. ", t) for t in out}
        elif found:
            out = {re.sub(pattern, c, t) if c else t for t, c in product(out, choices)}
    return out


def _forms(name: str, text: str) -> tuple[str, ...]:
    at = m.start() if name in STARTS and (m := re.search(STARTS[name], text, re.M)) else 0
    titles, body = ("", text[:at], *TITLES.get(name, ())), text[at:]
    bodies = {body}
    if m := re.search(r"^ *END OF TERMS AND CONDITIONS *$", body, re.M):
        bodies |= {body[: m.start()], body[: m.end()]}
    if m := re.search(r"^ADDENDUM: ", body, re.M):
        bodies.add(body[: m.start()])
    return tuple(sorted({f"{t.strip()}\n\n{b}" for x in bodies for b in _reworded(x) for t in titles}))


@functools.cache
def common() -> dict[str, str | tuple[str, ...]]:
    """licence_scan.KNOWN and the licences of `licences/`, each in all its forms."""
    texts = {f.name.removesuffix(".txt"): f.read_text() for f in sorted(FOLDER.glob("*.txt"))} | {k: v for k, v in KNOWN.items() if not k.endswith("-notice")}
    return KNOWN | {name: _forms(name, text) for name, text in texts.items()}
