"""The ordered signature rules of the licence scan.

Texts are matched as lower-case words joined by single spaces, so a rule is
written in words: ``apache license version 2 0``. A rule has a keyword (whole words,
or ``licen`` for every spelling that begins so) that must occur in the text before its
regex is tried (the prefilter), a label, a confidence and a priority: its
place in the list, earlier rules being the more specific ones.
"""

from __future__ import annotations

from typing import NamedTuple


class Rule(NamedTuple):
    rule_id: str
    label: str
    keyword: str
    pattern: str
    score: float


# label | keyword | words of the SPDX identifier | names, by hand. Versioned
# and otherwise narrower licences stand before their families.
LICENSES = r"""
agpl-3.0 | affero | agpl 3 0(?: only| or later)? | gnu affero general public licen[sc]e(?: as published by the free software foundation)?(?: either)?(?: version| v)? ?3(?: 0)?
agpl-1.0 | affero | agpl 1 0(?: only| or later)? | affero general public licen[sc]e(?: version| v) ?1(?: 0)?
agpl | affero | agpl | (?:gnu )?affero (?:general public licen[sc]e|gpl)
lgpl-3.0 | lesser | lgpl 3 0(?: only| or later)? | (?:gnu )?lesser general public licen[sc]e(?: as published by the free software foundation)?(?: either)?(?: version| v)? ?3(?: 0)?
lgpl-2.1 | lesser | lgpl 2 1(?: only| or later)? | (?:gnu )?lesser general public licen[sc]e(?: as published by the free software foundation)?(?: either)?(?: version| v)? ?2 1
lgpl-2.0 | library general | lgpl 2 0(?: only| or later)? | (?:gnu )?library general public licen[sc]e(?: as published by the free software foundation)?(?: either)?(?: version| v)? ?2(?: 0)?
lgpl | lesser | lgpl | (?:gnu )?(?:lesser|library) general public licen[sc]e
gpl-3.0-classpath | classpath | gpl 3 0 with classpath exception(?: 2 0)? | gnu general public licen[sc]e(?: version| v)? ?3(?: 0)? with(?: the)? classpath exception
gpl-2.0-classpath | classpath | gpl 2 0 with classpath exception(?: 2 0)? | (?:gnu )?(?:general public licen[sc]e|gpl)(?: version| v)? ?2(?: 0)?(?: only)? with(?: the)? classpath exception
gpl-3.0-or-later | later version | gpl 3 0 or later | gnu general public licen[sc]e as published by the free software foundation either version 3(?: 0)?(?: of the licen[sc]e)? or at your option any later version
gpl-2.0-or-later | later version | gpl 2 0 or later | gnu general public licen[sc]e as published by the free software foundation either version 2(?: 0)?(?: of the licen[sc]e)? or at your option any later version
gpl-3.0 | general public | gpl 3 0(?: only)? | (?:gnu )?general public licen[sc]e(?: gnu gpl| gpl)?(?: as published by the free software foundation)?(?: either)?(?: version| v)? ?3(?: 0)?
gpl-2.0 | general public | gpl 2 0(?: only)? | (?:gnu )?general public licen[sc]e(?: gnu gpl| gpl)?(?: as published by the free software foundation)?(?: either)?(?: version| v)? ?2(?: 0)?
gpl-1.0 | general public | gpl 1 0(?: only| or later)? | (?:gnu )?general public licen[sc]e(?: version| v) ?1(?: 0)?
gfdl-1.3 | free documentation | gfdl 1 3(?: only| or later)? | gnu free documentation licen[sc]e(?: version| v)? ?1 3
gfdl-1.2 | free documentation | gfdl 1 2(?: only| or later)? | gnu free documentation licen[sc]e(?: version| v)? ?1 2
gfdl | free documentation | gfdl | (?:gnu )?free documentation licen[sc]e
apache-2.0 | apache | apache 2 0 | apache (?:software )?licen[sc]e(?: version| v)? ?2(?: 0)?
apache-1.1 | apache | apache 1 1 | apache (?:software )?licen[sc]e(?: version| v)? ?1 1
apache-1.0 | apache | apache 1 0 | apache (?:software )?licen[sc]e(?: version| v)? ?1 0
cc-by-nc-nd-4.0 | cc by | cc by nc nd 4 0 | cc by nc nd(?: v)? ?4 0
cc-by-nc-nd-3.0 | cc by | cc by nc nd 3 0 | cc by nc nd(?: v)? ?3 0
cc-by-nc-nd | cc by | cc by nc nd | cc by nc nd
cc-by-nc-sa-4.0 | cc by | cc by nc sa 4 0 | cc by nc sa(?: v)? ?4 0
cc-by-nc-sa-3.0 | cc by | cc by nc sa 3 0 | cc by nc sa(?: v)? ?3 0
cc-by-nc-sa | cc by | cc by nc sa | cc by nc sa
cc-by-nc-4.0 | cc by | cc by nc 4 0 | cc by nc(?: v)? ?4 0
cc-by-nc-3.0 | cc by | cc by nc 3 0 | cc by nc(?: v)? ?3 0
cc-by-nc | cc by | cc by nc | cc by nc
cc-by-nd-4.0 | cc by | cc by nd 4 0 | cc by nd(?: v)? ?4 0
cc-by-nd | cc by | cc by nd | cc by nd
cc-by-sa-4.0 | cc by | cc by sa 4 0 | cc by sa(?: v)? ?4 0
cc-by-sa-3.0 | cc by | cc by sa 3 0 | cc by sa(?: v)? ?3 0
cc-by-sa | cc by | cc by sa | cc by sa
cc-by-4.0 | cc by | cc by 4 0 | cc by(?: v)? ?4 0
cc-by-3.0 | cc by | cc by 3 0 | cc by(?: v)? ?3 0
cc0-1.0 | cc0 | cc0 1 0 | cc0(?: 1 0)?(?: universal)?
bsd-4-clause | bsd | bsd 4 clause | (?:original|4 clause|four clause) bsd(?: licen[sc]e)?
bsd-3-clause | bsd | bsd 3 clause | (?:new|modified|revised|3 clause|three clause) bsd(?: licen[sc]e)?
bsd-2-clause | bsd | bsd 2 clause | (?:simplified|freebsd|2 clause|two clause)(?: bsd)? licen[sc]e
0bsd | bsd | 0bsd | (?:zero clause|0 clause) bsd(?: licen[sc]e)?
bsd | bsd | bsd | bsd(?: style| type)? licen[sc]e
mit-0 | no attribution licen | mit 0 | mit no attribution licen[sc]e
mit-modern | mit licen | mit modern variant | mit licen[sc]e modern variant
mpl-2.0 | mozilla | mpl 2 0 | mozilla public licen[sc]e(?: version| v)? ?2(?: 0)?
mpl-1.1 | mozilla | mpl 1 1 | mozilla public licen[sc]e(?: version| v)? ?1 1
mpl | mozilla | mpl | mozilla public licen[sc]e
epl-2.0 | eclipse | epl 2 0 | eclipse public licen[sc]e(?: version| v)? ?2(?: 0)?
epl-1.0 | eclipse | epl 1 0 | eclipse public licen[sc]e(?: version| v)? ?1(?: 0)?
edl-1.0 | eclipse | edl 1 0 | eclipse distribution licen[sc]e(?: version| v)?(?: 1 0)?
epl | eclipse | epl | eclipse public licen[sc]e
eupl-1.2 | european union | eupl 1 2 | european union public licen[sc]e(?: version| v)? ?1 2
eupl-1.1 | european union | eupl 1 1 | european union public licen[sc]e(?: version| v)? ?1 1
eupl | european union | eupl | european union public licen[sc]e
cddl-1.1 | common development | cddl 1 1 | common development and distribution licen[sc]e(?: version| v)? ?1 1
cddl-1.0 | common development | cddl 1 0 | common development and distribution licen[sc]e(?: version| v)?(?: 1 0)?
cpl-1.0 | common public | cpl 1 0 | common public licen[sc]e(?: version| v)?(?: 1 0)?
cpal-1.0 | common public attribution | cpal 1 0 | common public attribution licen[sc]e(?: version| v)?(?: 1 0)?
artistic-2.0 | artistic | artistic 2 0 | artistic licen[sc]e(?: version| v)? ?2(?: 0)?
artistic-1.0 | artistic | artistic 1 0 | artistic licen[sc]e(?: version| v)? ?1(?: 0)?
artistic | artistic | artistic | (?:perl )?artistic licen[sc]e
bsl-1.0 | boost | bsl 1 0 | boost software licen[sc]e(?: version| v)?(?: 1 0)?
busl-1.1 | business source | busl 1 1 | business source licen[sc]e(?: version| v)?(?: 1 1)?
isc | isc licen | isc | isc licen[sc]e
zlib | zlib | zlib | zlib(?: libpng)? licen[sc]e
libpng | libpng | libpng | libpng licen[sc]e
ncsa | illinois | ncsa | university of illinois(?: ncsa)? open source licen[sc]e
python-2.0 | python | python 2 0 | python(?: software foundation)? licen[sc]e(?: version| v)? ?2?
postgresql | postgresql | postgresql | postgresql licen[sc]e
openssl | openssl | openssl | openssl(?: ssleay)? licen[sc]e
php-3.01 | php licen | php 3 01 | php licen[sc]e(?: version| v)?(?: 3 01)?
ruby | ruby licen | ruby | ruby licen[sc]e
vim | vim licen | vim | vim licen[sc]e
wtfpl | wtfpl | wtfpl | wtfpl
unlicense | unlicense | unlicense | (?:the )?unlicense
ms-pl | microsoft | ms pl | microsoft public licen[sc]e
ms-rl | microsoft | ms rl | microsoft reciprocal licen[sc]e
ofl-1.1 | open font | ofl 1 1 | (?:sil )?open font licen[sc]e(?: version| v)?(?: 1 1)?
odbl-1.0 | open database | odbl 1 0 | open (?:data commons open )?database licen[sc]e(?: version| v)?(?: 1 0)?
odc-by-1.0 | attribution licen | odc by 1 0 | open data commons attribution licen[sc]e(?: version| v)?(?: 1 0)?
pddl-1.0 | public domain dedication | pddl 1 0 | (?:open data commons )?public domain dedication and licen[sc]e(?: version| v)?(?: 1 0)?
osl-3.0 | open software | osl 3 0 | open software licen[sc]e(?: version| v)?(?: 3 0)?
afl-3.0 | academic free | afl 3 0 | academic free licen[sc]e(?: version| v)?(?: 3 0)?
upl-1.0 | universal permissive | upl 1 0 | universal permissive licen[sc]e(?: version| v)?(?: 1 0)?
blueoak-1.0.0 | blue oak | blueoak 1 0 0 | blue oak model licen[sc]e(?: 1 0 0)?
sspl-1.0 | server side | sspl 1 0 | server side public licen[sc]e(?: version| v)?(?: 1 0?)?
elastic-2.0 | elastic | elastic 2 0 | elastic licen[sc]e(?: version| v)?(?: 2 0)?
ecl-2.0 | educational community | ecl 2 0 | educational community licen[sc]e(?: version| v)?(?: 2 0)?
cecill-2.1 | cecill | cecill 2 1 | cecill(?: free software)? licen[sc]e(?: agreement)?(?: version| v)?(?: 2 1)?
openrail-m | openrail | openrail m | (?:bigscience |creativeml )?openrail(?: m)?(?: licen[sc]e)?
mit-x11 | mit x11 licen | mit x11 | mit x11 licen[sc]e
mit | mit licen | mit | mit licen[sc]e
"""

# label | keyword | score | whole sentences and addresses, by hand.
TEXTS = r"""
mit | permission is hereby granted | 0.95 | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit | permission is hereby granted | 0.80 | permission is hereby granted free of charge to any person obtaining a copy
mit | opensource org | 0.85 | opensource org licen[sc]es mit(?: license php)?
isc | permission to use copy | 0.95 | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
bsd-3-clause | neither the name | 0.90 | neither the names? of .{1,120}? nor the names of(?: its| any)? contributors may be used to endorse or promote products
bsd-4-clause | advertising materials | 0.90 | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd | redistribution and use | 0.85 | redistribution and use in source and binary forms with or without modification are permitted
bsd-3-clause | opensource org | 0.85 | opensource org licen[sc]es bsd 3 clause
bsd-2-clause | opensource org | 0.85 | opensource org licen[sc]es bsd 2 clause
apache-2.0 | apache org | 0.90 | (?:www )?apache org licen[sc]es license 2 0(?: txt| html)?
apache-1.1 | apache org | 0.85 | (?:www )?apache org licen[sc]es license 1 1
apache | apache | 0.60 | apache licen[sc]e
gpl | general public | 0.60 | gnu general public licen[sc]e
gpl-3.0 | gnu org | 0.90 | (?:www )?gnu org licen[sc]es gpl 3 0(?: html| txt| en html)?
gpl-2.0 | gnu org | 0.90 | (?:www )?gnu org licen[sc]es (?:old licenses )?gpl 2 0(?: html| txt| en html)?
lgpl-2.1 | gnu org | 0.90 | (?:www )?gnu org licen[sc]es (?:old licenses )?lgpl 2 1(?: html| txt)?
lgpl-3.0 | gnu org | 0.90 | (?:www )?gnu org licen[sc]es lgpl 3 0(?: html| txt)?
agpl-3.0 | gnu org | 0.90 | (?:www )?gnu org licen[sc]es agpl 3 0(?: html| txt)?
gfdl | gnu org | 0.85 | (?:www )?gnu org licen[sc]es (?:old licenses )?fdl(?: 1 [123])?(?: html| txt)?
gpl | gnu org | 0.80 | (?:www )?gnu org licen[sc]es
gpl | free software | 0.75 | this (?:program|library|file) is free software you can redistribute it and or modify it
gpl | gpl | 0.75 | (?:gnu )?gpl(?: v| version)? ?[123](?: 0)?(?: or later)?
lgpl | lgpl | 0.75 | (?:gnu )?lgpl(?: v| version)? ?[23](?: [01])?(?: or later)?
agpl | agpl | 0.75 | (?:gnu )?agpl(?: v| version)? ?[13](?: 0)?(?: or later)?
mpl-2.0 | mozilla org | 0.90 | (?:www )?mozilla org (?:en us )?mpl 2 0
mpl-2.0 | source code form | 0.95 | this source code form is subject to the terms of the mozilla public licen[sc]e v 2 0
epl-2.0 | eclipse org | 0.90 | (?:www )?eclipse org legal epl (?:v20|2 0)(?: html)?
epl-1.0 | eclipse org | 0.90 | (?:www )?eclipse org legal epl (?:v10|1 0)(?: html)?
bsl-1.0 | boost org | 0.90 | (?:www )?boost org license 1 0(?: txt)?
artistic-2.0 | perlfoundation | 0.85 | (?:www )?perlfoundation org artistic license 2 0
unlicense | unencumbered | 0.95 | this is free and unencumbered software released into the public domain
unlicense | unlicense org | 0.90 | (?:www )?unlicense org
wtfpl | wtfpl net | 0.90 | (?:www )?wtfpl net
zlib | provided as is | 0.90 | this software is provided as is without any express or implied warranty in no event will the authors be held liable
cc0-1.0 | creativecommons org | 0.90 | creativecommons org publicdomain zero 1 0
cc-pdm-1.0 | creativecommons org | 0.90 | creativecommons org publicdomain mark 1 0
cc-by-nc-nd | creativecommons org | 0.90 | creativecommons org licen[sc]es by nc nd(?: [1-4] [05])?
cc-by-nc-sa | creativecommons org | 0.90 | creativecommons org licen[sc]es by nc sa(?: [1-4] [05])?
cc-by-nc | creativecommons org | 0.90 | creativecommons org licen[sc]es by nc(?: [1-4] [05])?
cc-by-nd | creativecommons org | 0.90 | creativecommons org licen[sc]es by nd(?: [1-4] [05])?
cc-by-sa | creativecommons org | 0.90 | creativecommons org licen[sc]es by sa(?: [1-4] [05])?
cc-by | creativecommons org | 0.90 | creativecommons org licen[sc]es by(?: [1-4] [05])?
cc-by-nc-nd | creative commons | 0.90 | creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: works)?(?: [1-4] [05])?(?: international| unported| generic)?(?: public)?(?: licen[sc]e)?
cc-by-nc-sa | creative commons | 0.90 | creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?(?: international| unported| generic)?(?: public)?(?: licen[sc]e)?
cc-by-nc | creative commons | 0.85 | creative commons attribution non ?commercial(?: [1-4] [05])?(?: international| unported| generic)?(?: public)?(?: licen[sc]e)?
cc-by-nd | creative commons | 0.85 | creative commons attribution no ?deriv(?:ative)?s(?: [1-4] [05])?(?: international| unported| generic)?(?: public)?(?: licen[sc]e)?
cc-by-sa | creative commons | 0.85 | creative commons attribution share ?alike(?: [1-4] [05])?(?: international| unported| generic)?(?: public)?(?: licen[sc]e)?
cc-by | creative commons | 0.80 | creative commons attribution(?: [1-4] [05])?(?: international| unported| generic)?(?: public)?(?: licen[sc]e)?
cc | creative commons | 0.60 | creative commons(?: public)? licen[sc]e
public-domain | public domain | 0.80 | (?:released|dedicated|placed|published) (?:in|into|to) the public domain
public-domain | public domain | 0.50 | (?:this (?:work|text|file|document) is )?in the public domain
proprietary | all rights reserved | 0.50 | copyright(?: c)?(?: [0-9]{4})?(?: by)? .{1,80}? all rights reserved
proprietary | all rights reserved | 0.40 | all rights reserved
proprietary | confidential | 0.60 | (?:proprietary and confidential|confidential and proprietary)
proprietary | prior written | 0.60 | (?:no part of this (?:work|publication|document)|unauthori[sz]ed copying) .{1,160}? prior written (?:permission|consent)
proprietary | internal use | 0.50 | for internal use only
non-commercial | non commercial | 0.60 | (?:for )?non commercial (?:use|purposes) only
non-commercial | noncommercial | 0.60 | (?:for )?noncommercial (?:use|purposes) only
wtfpl | want to public licen | 0.90 | do what the fuck you want to public licen[sc]e
non-commercial | commercial | 0.60 | may not be used for commercial purposes
research-only | research | 0.60 | for (?:academic|scientific|research)(?: and (?:academic|scientific|research))? (?:use|purposes) only
see-license | licen | 0.40 | see(?: the)?(?: accompanying)? licen[sc]e file(?: for details)?
warranty-disclaimer | warranty | 0.30 | without warranty of any kind(?: express or implied)?
warranty-disclaimer | warranties | 0.30 | without warranties or conditions of any kind(?: either)?(?: express or implied)?
warranty-disclaimer | merchantability | 0.30 | implied warranty of merchantability(?: or fitness for a particular purpose)?
"""

LICENSE_WORDS = ("license", "licence", "licenses", "licences", "licensed", "licenced")

# Whole-sentence frames around a licence's name.
GRANT = (r"(?:licen[sc]ed|released|distributed|published|available|provided|covered|governed|shared) "
         r"(?:under|by|with)(?: the terms of)?(?: the| a| an)? ")


def _rows(table: str) -> list[list[str]]:
    return [[cell.strip() for cell in line.split(" | ")] for line in table.strip().splitlines()]


def rules() -> list[Rule]:
    """All rules in order of priority: identifiers, grants, names, then texts."""
    table, out = _rows(LICENSES), []
    for label, _, spdx, _ in table:
        out.append(Rule(f"spdx:{label}", label, "spdx", rf"spdx licen[sc]e identifier {spdx}", 1.0))
    for label, keyword, _, name in table:
        out.append(Rule(f"grant:{label}", label, keyword, GRANT + rf"(?:{name})(?: licen[sc]e)?", 0.95))
    for label, keyword, _, name in table:
        out.append(Rule(f"name:{label}", label, keyword, rf"(?:{name})", 0.75))
    for n, (label, keyword, score, text) in enumerate(_rows(TEXTS)):
        out.append(Rule(f"text:{n}:{label}", label, keyword, rf"(?:{text})", float(score)))
    return out


# Fixed values of the contract: phrase -> label.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
