"""Signature rules for licence texts, tags and notices.

A rule is a line: priority (1 is strongest), label, keyword, pattern. The pattern is a row of word patterns; ``~`` after a
word makes it optional, ``*3`` stands for up to three words of any kind. A word is a regular expression for one whole
word, A-Z in lower case. The keyword points at the word to look for first: the first one that is not optional and has
the keyword in all its spellings. A text with none of these spellings is not searched for the rule.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

#: The phrases that count as places of the base labels, whatever else is found there.
BASE = """
3 gpl gnu gnu general public license
3 apache apache apache license
3 cc-by cc cc by
3 mit mit mit license
"""

#: Identifiers; each is a rule by itself (priority 2) and after the identifier tag (priority 1).
IDENTIFIERS = """
agpl-3.0 agpl agpl v?3 0~ only~
agpl-3.0-or-later agpl agpl v?3 0~ or later
apache-1.0 apache apache 1 0
apache-1.1 apache apache 1 1
apache-2.0 apache apache v?2 0~
artistic-1.0 artistic artistic 1 0
artistic-2.0 artistic artistic 2 0
bsd-0-clause bsd 0bsd
bsd-2-clause bsd bsd 2 clause
bsd-3-clause bsd bsd 3 clause
bsd-4-clause bsd bsd 4 clause
bsl-1.0 bsl bsl 1 0
busl-1.1 busl busl 1 1
cc0-1.0 cc0 cc0 1~ 0~
cc-by-1.0 cc cc by 1 0
cc-by-2.0 cc cc by 2 0
cc-by-2.5 cc cc by 2 5
cc-by-3.0 cc cc by 3 0
cc-by-4.0 cc cc by 4 0
cc-by-nc cc cc by nc
cc-by-nc-2.0 cc cc by nc 2 0
cc-by-nc-3.0 cc cc by nc 3 0
cc-by-nc-4.0 cc cc by nc 4 0
cc-by-nc-nd cc cc by nc nd
cc-by-nc-nd-3.0 cc cc by nc nd 3 0
cc-by-nc-nd-4.0 cc cc by nc nd 4 0
cc-by-nc-sa cc cc by nc sa
cc-by-nc-sa-3.0 cc cc by nc sa 3 0
cc-by-nc-sa-4.0 cc cc by nc sa 4 0
cc-by-nd cc cc by nd
cc-by-nd-3.0 cc cc by nd 3 0
cc-by-nd-4.0 cc cc by nd 4 0
cc-by-sa cc cc by sa
cc-by-sa-2.0 cc cc by sa 2 0
cc-by-sa-3.0 cc cc by sa 3 0
cc-by-sa-4.0 cc cc by sa 4 0
cddl-1.0 cddl cddl 1 0
cddl-1.1 cddl cddl 1 1
cecill-2.1 cecill cecill 2 1
cecill-b cecill cecill b
cecill-c cecill cecill c
cpl-1.0 cpl cpl 1 0
ecl-2.0 ecl ecl 2 0
epl-1.0 epl epl 1 0
epl-2.0 epl epl 2 0
eupl-1.1 eupl eupl v?1 1
eupl-1.2 eupl eupl v?1 2
fdl-1.2 gfdl gfdl v?1 2
fdl-1.3 gfdl gfdl v?1 3
gpl-1.0 gpl gpl v?1 0~ only~
gpl-2.0 gpl gpl v?2 0~ only~
gpl-2.0 gplv2 gplv2
gpl-2.0-or-later gpl gpl v?2 0~ or later
gpl-3.0 gpl gpl v?3 0~ only~
gpl-3.0 gplv3 gplv3
gpl-3.0-or-later gpl gpl v?3 0~ or later
isc isc isc license
lgpl-2.0 lgpl lgpl v?2 0~ only~
lgpl-2.1 lgpl lgpl v?2 1 only~
lgpl-2.1 lgplv2 lgplv2 1
lgpl-2.1-or-later lgpl lgpl v?2 1 or later
lgpl-3.0 lgpl lgpl v?3 0~ only~
lgpl-3.0 lgplv3 lgplv3
lgpl-3.0-or-later lgpl lgpl v?3 0~ or later
lppl-1.3c lppl lppl 1 3c
mit-0 mit mit 0
mpl-1.0 mpl mpl 1 0
mpl-1.1 mpl mpl 1 1
mpl-2.0 mpl mpl 2 0
ms-pl ms ms pl
ms-rl ms ms rl
ncsa ncsa ncsa license
odbl-1.0 odbl odbl 1 0
odc-by-1.0 odc odc by 1 0
ofl-1.1 ofl ofl 1 1
osl-3.0 osl osl 3 0
pddl-1.0 pddl pddl 1 0
postgresql postgresql postgresql license
psf-2.0 psf psf 2 0
python-2.0 python python 2 0
sspl-1.0 sspl sspl 1 0
unlicense unlicense unlicense
upl-1.0 upl upl 1 0
wtfpl wtfpl wtfpl
zlib zlib zlib license
zpl-2.1 zpl zpl 2 1
"""

#: Identifiers that are words of a language as well; they count after the identifier tag only.
TAGGED = """
mit mit mit
isc isc isc
zlib zlib zlib
ncsa ncsa ncsa
postgresql postgresql postgresql
vim vim vim
curl curl curl
ruby ruby ruby
x11 x11 x11
"""

#: Names, notices and characteristic sentences.
SIGNATURES = """
2 gpl-1.0 gnu gnu general public licen[cs]e *2 (version|v) 1 0~
2 gpl-2.0 gnu gnu general public licen[cs]e *2 (version|v) 2 0~ only~
2 gpl-3.0 gnu gnu general public licen[cs]e *2 (version|v) 3 0~ only~
2 gpl-2.0 gnu gnu general public licen[cs]e v2 0~
2 gpl-3.0 gnu gnu general public licen[cs]e v3 0~
2 gpl-2.0-or-later gnu gnu general public licen[cs]e *8 version 2 *4 or *4 any later version
2 gpl-3.0-or-later gnu gnu general public licen[cs]e *8 version 3 *4 or *4 any later version
2 gpl-2.0-or-later gnu gnu general public licen[cs]e *2 (version|v) 2 0~ or later
2 gpl-3.0-or-later gnu gnu general public licen[cs]e *2 (version|v) 3 0~ or later
3 gpl gpl licensed under the~ gpl
3 gpl gnu gnu gpl
3 gpl gnu terms of the gnu general public licen[cs]e
2 gpl gnu redistribute it and or modify it under the terms of the gnu general public licen[cs]e
2 lgpl-2.0 gnu gnu (library|lesser) general public licen[cs]e *2 (version|v) 2 0~
2 lgpl-2.1 gnu gnu lesser general public licen[cs]e *2 (version|v) 2 1
2 lgpl-3.0 gnu gnu lesser general public licen[cs]e *2 (version|v) 3 0~
3 lgpl gnu gnu (library|lesser) general public licen[cs]e
3 lgpl lgpl gnu~ lgpl
2 agpl-3.0 affero gnu~ affero general public licen[cs]e *2 (version|v) 3 0~
3 agpl affero gnu~ affero general public licen[cs]e
3 agpl agpl gnu~ agpl
2 fdl-1.2 gnu gnu free documentation licen[cs]e version~ 1 2
2 fdl-1.3 gnu gnu free documentation licen[cs]e version~ 1 3
3 fdl gnu gnu free documentation licen[cs]e
3 gpl-with-classpath-exception classpath classpath exception
3 gpl-with-linking-exception linking linking exception
2 apache-1.0 apache apache (software)~ licen[cs]e (version|v)~ 1 0
2 apache-1.1 apache apache (software)~ licen[cs]e (version|v)~ 1 1
2 apache-2.0 apache apache (software)~ licen[cs]e (version|v)~ 2 0~
2 apache-2.0 apache licensed under the apache licen[cs]e (version|v) 2 0
1 apache-2.0 apache www apache org licenses license 2 0
3 apache apache apache software licen[cs]e
3 apache apache (licensed|released|distributed) under *2 apache
2 mit mit (licensed|released|distributed|available) under *3 mit licen[cs]e
2 mit permission permission is hereby granted free of charge to any person obtaining a copy of this software
2 mit copyright the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
3 mit mit the mit licen[cs]e mit
3 mit mit mit style licen[cs]e
3 mit expat expat licen[cs]e
2 mit-0 mit mit no attribution
3 x11 x11 x11 licen[cs]e
2 isc permission permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
3 isc isc (licensed|released) under *2 isc
2 bsd-3-clause bsd (3|three) clause bsd
2 bsd-3-clause bsd (new|modified|revised) bsd licen[cs]e
2 bsd-2-clause bsd (2|two) clause bsd
2 bsd-2-clause licen (simplified|freebsd) (bsd)~ licen[cs]e
2 bsd-4-clause bsd (4|four) clause bsd
2 bsd-4-clause bsd original bsd licen[cs]e
2 bsd-0-clause bsd zero clause bsd
2 bsd redistribution redistribution and use in source and binary forms with or without modification are permitted
2 bsd-3-clause endorse neither the name of *12 may be used to endorse or promote products
2 bsd-4-clause advertising all advertising materials mentioning features or use of this software must display
3 bsd bsd bsd licen[cs]ed?
3 bsd bsd bsd style
2 mpl-1.0 mozilla mozilla public licen[cs]e (version|v)~ 1 0
2 mpl-1.1 mozilla mozilla public licen[cs]e (version|v)~ 1 1
2 mpl-2.0 mozilla mozilla public licen[cs]e (version|v)~ 2 0
1 mpl-2.0 mozilla this source code form is subject to the terms of the mozilla public licen[cs]e v 2 0
3 mpl mozilla mozilla public licen[cs]e
2 epl-1.0 eclipse eclipse public licen[cs]e (version|v)~ 1 0
2 epl-2.0 eclipse eclipse public licen[cs]e (version|v)~ 2 0
3 epl eclipse eclipse public licen[cs]e
2 edl-1.0 eclipse eclipse distribution licen[cs]e (version|v)~ 1 0
2 cddl-1.0 distribution common development and distribution licen[cs]e (version|v)~ 1 0
2 cddl-1.1 distribution common development and distribution licen[cs]e (version|v)~ 1 1
3 cddl distribution common development and distribution licen[cs]e
2 cpl-1.0 common common public licen[cs]e (version|v)~ 1 0
2 cpal-1.0 attribution common public attribution licen[cs]e
2 ipl-1.0 ibm ibm public licen[cs]e
2 eupl-1.1 european european union public licen[cs]e (version|v)~ 1 1
2 eupl-1.2 european european union public licen[cs]e (version|v)~ 1 2
3 eupl european european union public licen[cs]e
3 cecill cecill cecill free~ software~ licen[cs]e
2 bsl-1.0 boost boost software licen[cs]e (version|v)~ 1 0
3 bsl-1.0 boost boost software licen[cs]e
2 busl-1.1 business business source licen[cs]e (version|v)~ 1 1
3 busl business business source licen[cs]e
2 sspl-1.0 licen server side public licen[cs]e
3 elastic elastic elastic licen[cs]e
2 elastic-2.0 elastic elastic licen[cs]e 2 0
2 artistic-1.0 artistic artistic licen[cs]e (version|v)~ 1 0
2 artistic-2.0 artistic artistic licen[cs]e (version|v)~ 2 0
3 artistic artistic (perl)~ artistic licen[cs]e
3 artistic perl under the same terms as perl itself
3 psf python python software foundation licen[cs]e
3 ruby ruby ruby licen[cs]e
3 php php php licen[cs]e
3 vim vim vim licen[cs]e
3 w3c w3c w3c software *3 licen[cs]e
3 openssl openssl openssl licen[cs]e
3 ofl sil sil open font licen[cs]e
2 ofl-1.1 sil sil open font licen[cs]e (version|v)~ 1 1
3 lppl latex latex project public licen[cs]e
2 lppl-1.3c latex latex project public licen[cs]e *2 1 3c?
3 ms-pl microsoft microsoft public licen[cs]e
3 ms-rl microsoft microsoft reciprocal licen[cs]e
3 osl licen open software licen[cs]e
2 osl-3.0 licen open software licen[cs]e (version|v)~ 3 0
3 afl academic academic free licen[cs]e
3 ecl educational educational community licen[cs]e
3 upl permissive universal permissive licen[cs]e
3 zpl zope zope public licen[cs]e
3 qpl licen q public licen[cs]e
3 ncsa illinois university of illinois *2 open source licen[cs]e
3 odbl database open (data)~ (commons)~ (open)~ database licen[cs]e
3 odc-by attribution open data commons attribution licen[cs]e
3 pddl dedication open data commons public domain dedication
3 ogl government open government licen[cs]e
3 cdla licen community data licen[cs]e agreement
3 openrail openrail (creativeml)~ (open)~ openrail m~
3 llama llama llama [23]~ community licen[cs]e
3 zlib zlib zlib libpng
2 zlib warranty this software is provided as is without any express or implied warranty in no event will the authors
2 wtfpl licen do what the (fuck)~ you want to public licen[cs]e
2 unlicense unencumbered this is free and unencumbered software released into the public domain
3 beerware beer beer ware licen[cs]e
3 jsond evil the software shall be used for good not evil
2 cc0-1.0 creative creative commons (cc0|zero) *3 1 0
3 cc0 cc (cc0|cco) public~ domain~ dedication~
2 cc-by-4.0 creative creative commons attribution 4 0
2 cc-by-3.0 creative creative commons attribution 3 0
2 cc-by-4.0 creative creative commons attribution (licen[cs]e)~ version~ 4 0
2 cc-by-sa-4.0 creative creative commons attribution share alike (licen[cs]e)~ 4 0
2 cc-by-sa-4.0 creative creative commons attribution sharealike (licen[cs]e)~ 4 0
2 cc-by-sa-3.0 creative creative commons attribution sharealike (licen[cs]e)~ 3 0
2 cc-by-nc-4.0 creative creative commons attribution non commercial (licen[cs]e)~ 4 0
2 cc-by-nc-4.0 creative creative commons attribution noncommercial (licen[cs]e)~ 4 0
2 cc-by-nc-sa-4.0 creative creative commons attribution noncommercial sharealike (licen[cs]e)~ 4 0
2 cc-by-nc-nd-4.0 creative creative commons attribution noncommercial (noderivs|noderivatives) (licen[cs]e)~ 4 0
2 cc-by-nd-4.0 creative creative commons attribution (noderivs|noderivatives) (licen[cs]e)~ 4 0
3 cc-by creative creative commons attribution
3 cc-by-sa creative creative commons attribution share alike
3 cc-by-sa creative creative commons attribution sharealike
3 cc-by-nc creative creative commons attribution non~ (commercial|noncommercial)
1 cc-by-4.0 creativecommons creativecommons org licenses by 4 0
1 cc-by-3.0 creativecommons creativecommons org licenses by 3 0
1 cc-by-sa-4.0 creativecommons creativecommons org licenses by sa 4 0
1 cc-by-sa-3.0 creativecommons creativecommons org licenses by sa 3 0
1 cc-by-nc-4.0 creativecommons creativecommons org licenses by nc 4 0
1 cc-by-nc-sa-4.0 creativecommons creativecommons org licenses by nc sa 4 0
1 cc-by-nc-nd-4.0 creativecommons creativecommons org licenses by nc nd 4 0
1 cc-by-nd-4.0 creativecommons creativecommons org licenses by nd 4 0
1 cc0-1.0 creativecommons creativecommons org publicdomain zero 1 0
4 creative-commons creative creative commons (licen[cs]ed?)~
4 public-domain domain (dedicated|released) *2 to~ *2 the public domain
4 public-domain domain (in|into|as) the~ public domain
4 copyleft copyleft copyleft(ed)?
4 open-source licen open source licen[cs]e
4 free-software licen free software licen[cs]e
4 dual-license dual dual licen[cs]ed
4 dual-license dual dual licen[cs]e
4 proprietary proprietary proprietary (and|software|licen[cs]e) (confidential|licen[cs]e)~
4 proprietary confidential confidential and proprietary
4 proprietary unauthorized unauthorized (copying|reproduction|use|distribution)
4 proprietary licen commercial licen[cs]e
4 proprietary licen evaluation licen[cs]e
4 eula licen end user licen[cs]e agreement
4 all-rights-reserved reserved all rights reserved
4 some-rights-reserved reserved some rights reserved
4 no-warranty warranty without warranty of any kind
4 no-warranty warrant without any warranty
4 permission permission used (with|by) permission
4 copyright copyright copyright (c|by)~ (19|20)[0-9][0-9]
4 copyright copyright copyright notice
4 royalty-free royalty royalty free
4 licensed-under licensed licensed under *2 (terms|licen[cs]e)
4 licensed-under file see *3 (license|copying) file
"""

@dataclass(frozen=True)
class Rule:
    number: int
    priority: int
    label: str
    keywords: tuple[str, ...]
    pattern: str
    base: bool


def word_pattern(words: str) -> str:
    """The regular expression for a row of word patterns, over text whose words are written STX word SOH index."""
    out = []
    for word in words.split():
        if word.startswith("*"):
            out.append(r"(?:\x02[^\x01]+\x01[0-9]+){0," + word[1:] + "}")
        elif word.endswith("~"):
            out.append(rf"(?:\x02(?:{word[:-1]})\x01[0-9]+)?")
        else:
            out.append(rf"\x02(?:{word})\x01[0-9]+")
    return "".join(out)


def spellings(pattern: str) -> list[str]:
    """All words that a word pattern of letters, ``[..]``, ``(a|b)`` and ``?`` matches; [0-9] is left out as too many."""
    if "[0-9]" in pattern:
        return []
    found = [""]
    for part, optional in re.findall(r"(\([^)]*\)|\[[^\]]*\]|[^?])(\??)", pattern):
        inner = part[1:-1] if part[0] in "([" else part
        choices = [w for p in inner.split("|") for w in spellings(p)] if part[0] == "(" else list(inner)
        found = [f + c for f in found for c in choices + [""] * bool(optional)]
    return found


def _keywords(keyword: str, words: str) -> tuple[str, ...]:
    for word in words.split():
        if not word.startswith("*") and not word.endswith("~"):
            found = spellings(word)
            if found and all(keyword in f for f in found):
                return tuple(found)
    raise ValueError(f"no word of {words!r} must hold {keyword!r}")


def _rules() -> list[Rule]:
    lines = [(True, line.split(None, 3)) for line in BASE.strip().splitlines()]
    identifiers = [line.split(None, 2) for line in IDENTIFIERS.strip().splitlines()]
    lines += [(False, ["2", *parts]) for parts in identifiers]
    tagged = identifiers + [line.split(None, 2) for line in TAGGED.strip().splitlines()]
    lines += [(False, ["1", label, "spdx", f"spdx licen[cs]e identifier {words}"]) for label, _, words in tagged]
    lines += [(False, line.split(None, 3)) for line in SIGNATURES.strip().splitlines()]
    return [Rule(k, int(p), label, _keywords(keyword, words), word_pattern(words), base) for k, (base, (p, label, keyword, words)) in enumerate(lines)]


RULES = _rules()
