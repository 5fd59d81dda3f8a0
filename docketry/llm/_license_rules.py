"""License signatures: ordered rules written by hand, one a line: ``label | priority | keyword | pattern``.

Patterns run over lower-cased words joined by single spaces and match whole words. The keyword begins a word of every match of
its pattern. ``LIC`` is either spelling of license, ``{2}`` a version number with its usual words before it, ``LATER``
the words for "or any later version". Priorities: 100 identifiers, 90 grants, 80 sentences of a license's own text,
70 names with version and form, 60 names with version, 50 names, 40 short forms.
"""

from __future__ import annotations

import re

TEXT = r"""
mit | 100 | spdx | spdx LIC identifier mit
mit | 90 | mit | (?:licensed|licenced|released|distributed|available|provided|published) under (?:the )?(?:terms of (?:the )?)?mit(?: LIC)?
mit | 90 | expat | (?:licensed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?(?:mit )?expat(?: LIC)?
mit | 90 | x11 | (?:licensed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?(?:mit )?x11(?: LIC)?
mit | 80 | permission | permission is hereby granted free of charge to any person obtaining a copy
mit | 80 | substantial | (?:shall be included in )?all copies or substantial portions of the software
mit | 50 | mit | (?:the )?mit LIC
mit | 50 | mit | mit x11(?: LIC)?
mit | 50 | expat | (?:mit )?expat LIC
mit | 50 | x11 | (?:mit )?x11 LIC
mit | 50 | mit | LIC (?:is )?(?:the )?mit
mit | 40 | mit | mit licensed
mit-0 | 100 | spdx | spdx LIC identifier mit 0
mit-0 | 60 | mit | mit(?: LIC)? no attribution
mit-0 | 60 | mit | mit 0(?: LIC)?
apache-2 | 100 | spdx | spdx LIC identifier apache 2 0
apache-2 | 90 | apache | (?:licensed|released|distributed|available|provided) under (?:the )?(?:terms of (?:the )?)?apache(?: software)?(?: foundation)?(?: LIC)?{2}
apache-2 | 80 | apache | www apache org licenses LIC 2 0
apache-2 | 80 | required | unless required by applicable law or agreed to in writing software distributed under the LIC
apache-2 | 60 | apache | apache(?: software)?(?: foundation)? LIC{2}
apache-2 | 60 | apache | apache{2}(?: LIC)?
apache-2 | 50 | asl | asl{2}
apache-1.1 | 100 | spdx | spdx LIC identifier apache 1 1
apache-1.1 | 90 | apache | licensed under (?:the )?apache(?: software)?(?: LIC)?{1.1}
apache-1.1 | 60 | apache | apache(?: software)?(?: LIC)?{1.1}
apache-1.1 | 80 | apache | this product includes software developed by the apache (?:group|software foundation)
apache-1.0 | 100 | spdx | spdx LIC identifier apache 1 0
apache-1.0 | 60 | apache | apache(?: software)?(?: LIC)?{1.0}
apache | 50 | apache | (?:licensed|released|distributed) under (?:the )?apache(?: software)? LIC
apache | 40 | apache | apache(?: software)? LIC
bsd-2 | 100 | spdx | spdx LIC identifier bsd 2 clause
bsd-2 | 90 | bsd | (?:licensed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?(?:bsd 2 clause|2 clause bsd|simplified bsd)(?: LIC)?
bsd-2 | 70 | bsd | bsd 2 clause(?: LIC)?
bsd-2 | 70 | clause | (?:2|two) clause bsd(?: style)?(?: LIC)?
bsd-2 | 60 | simplified | simplified bsd(?: LIC)?
bsd-2 | 60 | freebsd | freebsd(?: documentation)? LIC
bsd-2 | 60 | freebsd | (?:under|with|see|of) the freebsd
bsd-3 | 100 | spdx | spdx LIC identifier bsd 3 clause
bsd-3 | 90 | bsd | (?:licensed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?(?:bsd 3 clause|3 clause bsd|new bsd|revised bsd|modified bsd)(?: LIC)?
bsd-3 | 80 | neither | neither the name of .{1,80}? nor the names of its contributors may be used to endorse or promote products
bsd-3 | 70 | bsd | bsd 3 clause(?: LIC)?
bsd-3 | 70 | clause | (?:3|three) clause bsd(?: style)?(?: LIC)?
bsd-3 | 60 | bsd | (?:new|revised|modified) bsd(?: LIC)?
bsd-4 | 100 | spdx | spdx LIC identifier bsd 4 clause
bsd-4 | 80 | advertising | all advertising materials mentioning features or use of this software must display
bsd-4 | 70 | bsd | bsd 4 clause(?: LIC)?
bsd-4 | 70 | clause | (?:4|four) clause bsd(?: LIC)?
bsd-4 | 60 | bsd | (?:original|old) bsd(?: LIC)?
bsd-1 | 100 | spdx | spdx LIC identifier bsd 1 clause
bsd-1 | 70 | bsd | bsd 1 clause(?: LIC)?
0bsd | 100 | spdx | spdx LIC identifier 0bsd
0bsd | 60 | 0bsd | 0bsd(?: LIC)?
0bsd | 60 | zero | (?:bsd zero clause|zero clause bsd)(?: LIC)?
bsd | 80 | redistribution | redistribution and use in source and binary forms with or without modification are permitted
bsd | 50 | bsd | (?:licensed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?bsd(?: style)?(?: LIC)?
bsd | 40 | bsd | bsd(?: style)? LIC
bsd | 40 | bsd | (?:under|with|see) the bsd
gpl-1 | 100 | spdx | spdx LIC identifier gpl 1 0(?: only)?
gpl-1 | 60 | gpl | (?:gnu )?gpl{1}
gpl-1 | 60 | general | (?:gnu )?general public LIC{1}
gpl-1-or-later | 100 | spdx | spdx LIC identifier gpl 1 0 or later
gpl-2 | 100 | spdx | spdx LIC identifier gpl 2 0(?: only)?
gpl-2 | 90 | gpl | (?:licensed|released|distributed|available|published) under (?:the )?(?:terms of (?:the )?)?(?:gnu )?gpl{2}(?: only)?
gpl-2 | 90 | general | under (?:the )?(?:terms of (?:the )?)?(?:gnu )?general public LIC{2}(?: only)?
gpl-2 | 80 | general | gnu general public LIC as published by the free software foundation version 2
gpl-2 | 60 | gpl | (?:gnu )?gpl{2}(?: only)?
gpl-2 | 60 | general | (?:gnu )?general public LIC{2}(?: only)?
gpl-2-or-later | 100 | spdx | spdx LIC identifier gpl 2 0 or later
gpl-2-or-later | 95 | general | general public LIC as published by the free software foundation either version 2 of the LICLATER
gpl-2-or-later | 95 | gpl | (?:licensed under (?:the )?)?(?:gnu )?gpl{2}LATER
gpl-2-or-later | 95 | general | (?:gnu )?general public LIC{2}LATER
gpl-2-classpath | 97 | classpath | (?:gpl|general public LIC){2} with (?:the )?classpath exception
gpl-3 | 100 | spdx | spdx LIC identifier gpl 3 0(?: only)?
gpl-3 | 90 | gpl | (?:licensed|released|distributed|available|published) under (?:the )?(?:terms of (?:the )?)?(?:gnu )?gpl{3}(?: only)?
gpl-3 | 90 | general | under (?:the )?(?:terms of (?:the )?)?(?:gnu )?general public LIC{3}(?: only)?
gpl-3 | 80 | general | gnu general public LIC as published by the free software foundation version 3
gpl-3 | 60 | gpl | (?:gnu )?gpl{3}(?: only)?
gpl-3 | 60 | general | (?:gnu )?general public LIC{3}(?: only)?
gpl-3-or-later | 100 | spdx | spdx LIC identifier gpl 3 0 or later
gpl-3-or-later | 95 | general | general public LIC as published by the free software foundation either version 3 of the LICLATER
gpl-3-or-later | 95 | gpl | (?:licensed under (?:the )?)?(?:gnu )?gpl{3}LATER
gpl-3-or-later | 95 | general | (?:gnu )?general public LIC{3}LATER
gpl | 80 | general | you should have received a copy of the gnu general public LIC
gpl | 50 | gpl | (?:licensed|released|distributed|available|published) under (?:the )?(?:terms of (?:the )?)?(?:gnu )?gpl
gpl | 50 | general | (?:gnu )?general public LIC
gpl | 40 | gpl | (?:gnu )?gpl(?: LIC| licensed)?
lgpl-2.0 | 100 | spdx | spdx LIC identifier lgpl 2 0(?: only| or later)?
lgpl-2.0 | 65 | lgpl | (?:gnu )?lgpl{2}(?: only)?
lgpl-2.0 | 65 | library | (?:gnu )?library general public LIC(?:{2})?
lgpl-2.0 | 65 | lesser | (?:gnu )?lesser general public LIC{2}
lgpl-2.0-or-later | 95 | lgpl | (?:gnu )?lgpl{2}LATER
lgpl-2.0-or-later | 95 | library | (?:gnu )?library general public LIC{2}LATER
lgpl-2.1 | 100 | spdx | spdx LIC identifier lgpl 2 1(?: only)?
lgpl-2.1 | 70 | lgpl | (?:gnu )?lgpl{2.1}(?: only)?
lgpl-2.1 | 70 | lesser | (?:gnu )?lesser general public LIC{2.1}(?: only)?
lgpl-2.1-or-later | 100 | spdx | spdx LIC identifier lgpl 2 1 or later
lgpl-2.1-or-later | 96 | lgpl | (?:gnu )?lgpl{2.1}LATER
lgpl-2.1-or-later | 96 | lesser | (?:gnu )?lesser general public LIC{2.1}LATER
lgpl-2.1-or-later | 96 | lesser | lesser general public LIC as published by the free software foundation either version 2 1 of the LICLATER
lgpl-3 | 100 | spdx | spdx LIC identifier lgpl 3 0(?: only)?
lgpl-3 | 70 | lgpl | (?:gnu )?lgpl{3}(?: only)?
lgpl-3 | 70 | lesser | (?:gnu )?lesser general public LIC{3}(?: only)?
lgpl-3-or-later | 100 | spdx | spdx LIC identifier lgpl 3 0 or later
lgpl-3-or-later | 96 | lgpl | (?:gnu )?lgpl{3}LATER
lgpl-3-or-later | 96 | lesser | (?:gnu )?lesser general public LIC{3}LATER
lgpl | 55 | lgpl | (?:gnu )?lgpl(?: LIC| licensed)?
lgpl | 55 | lesser | (?:gnu )?lesser general public LIC
lgpl | 55 | library | (?:gnu )?library gpl
agpl-1 | 100 | spdx | spdx LIC identifier agpl 1 0(?: only| or later)?
agpl-1 | 70 | agpl | agpl{1}
agpl-1 | 70 | affero | affero(?: general)?(?: public)?(?: LIC)?{1}
agpl-3 | 100 | spdx | spdx LIC identifier agpl 3 0(?: only)?
agpl-3 | 70 | agpl | (?:gnu )?agpl{3}(?: only)?
agpl-3 | 70 | affero | (?:gnu )?affero general public LIC{3}(?: only)?
agpl-3-or-later | 100 | spdx | spdx LIC identifier agpl 3 0 or later
agpl-3-or-later | 96 | agpl | (?:gnu )?agpl{3}LATER
agpl-3-or-later | 96 | affero | (?:gnu )?affero general public LIC{3}LATER
agpl-3-or-later | 96 | affero | affero general public LIC as published by the free software foundation either version 3 of the LICLATER
agpl | 55 | agpl | (?:gnu )?agpl(?: LIC| licensed)?
agpl | 55 | affero | (?:gnu )?affero general public LIC
gfdl-1.1 | 70 | free | (?:gnu )?free documentation LIC{1.1}
gfdl-1.2 | 70 | free | (?:gnu )?free documentation LIC{1.2}
gfdl-1.3 | 70 | free | (?:gnu )?free documentation LIC{1.3}
gfdl-1.2 | 70 | gfdl | gfdl{1.2}
gfdl-1.3 | 70 | gfdl | gfdl{1.3}
gfdl | 50 | free | (?:gnu )?free documentation LIC
gfdl | 40 | gfdl | gfdl
mpl-1.0 | 70 | mozilla | mozilla public LIC{1.0}
mpl-1.0 | 70 | mpl | mpl{1.0}
mpl-1.1 | 100 | spdx | spdx LIC identifier mpl 1 1
mpl-1.1 | 70 | mozilla | mozilla public LIC{1.1}
mpl-1.1 | 70 | mpl | mpl{1.1}
mpl-2 | 100 | spdx | spdx LIC identifier mpl 2 0
mpl-2 | 90 | mozilla | subject to the terms of the mozilla public LIC{2}
mpl-2 | 80 | mozilla | mozilla org mpl 2 0
mpl-2 | 70 | mozilla | mozilla public LIC{2}
mpl-2 | 70 | mpl | mpl{2}
mpl | 50 | mozilla | mozilla public LIC
epl-1 | 100 | spdx | spdx LIC identifier epl 1 0
epl-1 | 70 | eclipse | eclipse public LIC{1}
epl-1 | 70 | epl | epl{1}
epl-2 | 100 | spdx | spdx LIC identifier epl 2 0
epl-2 | 70 | eclipse | eclipse public LIC{2}
epl-2 | 70 | epl | epl{2}
epl | 50 | eclipse | eclipse public LIC
edl | 60 | eclipse | eclipse distribution LIC(?:{1})?
cddl-1.0 | 100 | spdx | spdx LIC identifier cddl 1 0
cddl-1.0 | 70 | common | common development and distribution LIC{1.0}
cddl-1.0 | 70 | cddl | cddl{1.0}
cddl-1.1 | 100 | spdx | spdx LIC identifier cddl 1 1
cddl-1.1 | 70 | common | common development and distribution LIC{1.1}
cddl-1.1 | 70 | cddl | cddl{1.1}
cddl | 50 | common | common development and distribution LIC
cddl | 40 | cddl | cddl
cpl | 60 | common | common public LIC(?:{1})?
eupl-1.1 | 70 | european | european union public LIC{1.1}
eupl-1.1 | 70 | eupl | eupl{1.1}
eupl-1.2 | 70 | european | european union public LIC{1.2}
eupl-1.2 | 70 | eupl | eupl{1.2}
eupl | 50 | european | european union public LIC
eupl | 40 | eupl | eupl
isc | 100 | spdx | spdx LIC identifier isc
isc | 80 | permission | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc | 50 | isc | isc LIC
isc | 50 | isc | (?:licensed|released|distributed) under (?:the )?isc
zlib | 100 | spdx | spdx LIC identifier zlib
zlib | 80 | misrepresented | the origin of this software must not be misrepresented
zlib | 50 | zlib | zlib(?: libpng)? LIC
zlib | 50 | zlib | (?:licensed|released|distributed) under (?:the )?zlib
boost | 100 | spdx | spdx LIC identifier bsl 1 0
boost | 70 | boost | boost software LIC(?:{1})?
boost | 50 | boost | boost LIC
unlicense | 100 | spdx | spdx LIC identifier unlicense
unlicense | 80 | unencumbered | free and unencumbered software released into the public domain
unlicense | 50 | unlicense | (?:the )?unlicense
wtfpl | 50 | wtfpl | wtfpl
wtfpl | 70 | what | do what the fuck you want to public LIC
artistic-1 | 70 | artistic | artistic LIC{1}
artistic-2 | 100 | spdx | spdx LIC identifier artistic 2 0
artistic-2 | 70 | artistic | artistic LIC{2}
artistic | 50 | artistic | artistic LIC
perl | 70 | perl | same terms as perl itself
python | 100 | spdx | spdx LIC identifier (?:python|psf) 2 0
python | 60 | python | python software foundation LIC
python | 60 | psf | psf LIC(?: agreement)?
ruby | 50 | ruby | ruby LIC
php | 50 | php | php LIC(?:{3})?
w3c | 50 | w3c | w3c(?: software)?(?: notice and)? LIC
ms-pl | 60 | microsoft | microsoft public LIC
ms-rl | 60 | microsoft | microsoft reciprocal LIC
ibm | 50 | ibm | ibm public LIC
openssl | 60 | openssl | openssl LIC
vim | 50 | vim | vim LIC
postgresql | 60 | postgresql | postgresql LIC
ncsa | 60 | ncsa | (?:university of illinois )?ncsa(?: open source)? LIC
afl | 60 | academic | academic free LIC(?:{3})?
osl-3 | 70 | open | open software LIC{3}
osl | 50 | open | open software LIC
upl | 70 | universal | universal permissive LIC(?:{1})?
ecl-2 | 70 | educational | educational community LIC{2}
sspl | 70 | server | server side public LIC(?:{1})?
busl | 70 | business | business source LIC(?:{1.1})?
elastic-2 | 70 | elastic | elastic LIC{2}
cecill | 60 | cecill | cecill(?: [abc])?(?:{2.1})?(?: LIC)?
ofl-1.1 | 100 | spdx | spdx LIC identifier ofl 1 1
ofl-1.1 | 70 | open | (?:sil )?open font LIC{1.1}
ofl | 50 | open | (?:sil )?open font LIC
odbl | 100 | spdx | spdx LIC identifier odbl 1 0
odbl | 60 | open | open database LIC(?:{1})?
odbl | 40 | odbl | odbl
odc-by | 70 | open | open data commons attribution(?: LIC)?
pddl | 70 | public | public domain dedication and LIC
cc0 | 100 | spdx | spdx LIC identifier cc0 1 0
cc0 | 70 | cc0 | cc0(?: 1 0)?(?: universal)?
cc0 | 60 | creative | creative commons zero(?: LIC)?
cc-pd | 60 | public | public domain mark(?: 1 0)?
public-domain | 70 | public | (?:released|placed|dedicated) (?:in|into|to) the public domain
public-domain | 40 | public | this (?:work|file|software) is in the public domain
cc-by-nc-nd | 70 | cc | cc by nc nd(?: [1-4] [05])?
cc-by-nc-nd | 70 | creative | creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?(?: [1-4] [05])?(?: international| unported)?(?: LIC)?
cc-by-nc-sa | 70 | cc | cc by nc sa(?: [1-4] [05])?
cc-by-nc-sa | 70 | creative | creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?(?: international| unported)?(?: LIC)?
cc-by-nc | 65 | cc | cc by nc(?: [1-4] [05])?
cc-by-nc | 65 | creative | creative commons attribution non ?commercial(?: [1-4] [05])?(?: international| unported)?(?: LIC)?
cc-by-nd | 65 | cc | cc by nd(?: [1-4] [05])?
cc-by-nd | 65 | creative | creative commons attribution no ?deriv(?:ative)?s?(?: works)?(?: [1-4] [05])?(?: international| unported)?(?: LIC)?
cc-by-sa | 65 | cc | cc by sa(?: [1-4] [05])?
cc-by-sa | 65 | creative | creative commons attribution share ?alike(?: [1-4] [05])?(?: international| unported)?(?: LIC)?
cc-by | 60 | cc | cc by(?: [1-4] [05])?
cc-by | 60 | creative | creative commons attribution(?: [1-4] [05])?(?: international| unported)?(?: LIC)?
cc | 40 | creative | creative commons LIC
proprietary | 70 | proprietary | proprietary and confidential
proprietary | 50 | proprietary | proprietary LIC
proprietary | 60 | rights | all rights reserved (?:unauthorized|no part of this) (?:copying|publication|reproduction)?
commercial | 50 | commercial | (?:under|requires) a commercial LIC
non-commercial | 50 | non | for non ?commercial use only
"""

LATER = r" (?:or (?:at your option )?|and )(?:any )?(?:later|newer|above)(?: version)?"


def _version(m: re.Match) -> str:
    major, _, minor = m[1].partition(".")
    return f"(?: LIC)?(?: version| ver)? ?v? ?{major} {minor}" if minor else f"(?: LIC)?(?: version| ver)? ?v? ?{major}(?: 0)?"


def rules() -> list[tuple[str, int, str, str]]:
    """``(label, priority, keyword, pattern)`` in order."""
    out = []
    for line in TEXT.strip().split("\n"):
        label, priority, keyword, pattern = line.split(" | ", 3)
        pattern = re.sub(r"\{([0-9.]+)\}", _version, pattern).replace("LATER", LATER).replace("LIC", "licen[sc]e")
        out.append((label, int(priority), keyword, pattern))
    return out
