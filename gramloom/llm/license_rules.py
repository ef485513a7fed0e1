"""The signature rules of :mod:`license_scan`.

Rules read texts as words (0-9, a-z and everything from U+0080) with one blank between them,
so "Apache License, Version 2.0" is ``apache license version 2 0``.  In the patterns below a
blank is a gap between words, a blank with a question mark a gap or nothing, and ``~`` stands
for any one word.
"""

from __future__ import annotations

from dataclasses import dataclass

#: Licences by label, identifier in tags, and name in running text.
FAMILIES = """
mit | mit | (?:mit|expat|mit x11|x11) licen[sc]e
mit-0 | mit 0 | mit no attribution licen[sc]e
apache-1.1 | apache 1 1 | apache (?:software )?licen[sc]e(?: version)?(?: v1| 1) 1
apache-2.0 | apache 2 0 | apache (?:software )?licen[sc]e(?: version)?(?: v2| 2)(?: 0)?
bsd-2-clause | bsd 2 clause | (?:(?:simplified|freebsd) bsd|bsd 2 clause|2 clause bsd) licen[sc]e
bsd-3-clause | bsd 3 clause | (?:(?:new|modified|revised) bsd|bsd 3 clause|3 clause bsd) licen[sc]e
bsd-4-clause | bsd 4 clause | (?:(?:original|old) bsd|bsd 4 clause|4 clause bsd) licen[sc]e
0bsd | 0bsd | (?:zero clause bsd|0bsd|bsd zero clause) licen[sc]e
isc | isc | isc licen[sc]e
zlib | zlib | zlib(?: libpng)? licen[sc]e
libpng | libpng(?: 2 0)? | (?:png reference library|libpng) licen[sc]e
bsl-1.0 | bsl 1 0 | boost software licen[sc]e(?: version)?(?: 1 0)?
unlicense | unlicense | (?:the unlicense|unlicense org)
wtfpl | wtfpl | do what the ~ you want to public licen[sc]e
ncsa | ncsa | (?:university of illinois )?ncsa(?: open source)? licen[sc]e
postgresql | postgresql | postgresql licen[sc]e
python-2.0 | (?:python|psf) 2 0 | (?:python software foundation|psf|python) licen[sc]e
openssl | openssl | openssl licen[sc]e
php-3.01 | php 3 01 | php licen[sc]e(?: version)?(?: 3 01)?
ruby | ruby | ruby licen[sc]e
artistic-1.0 | artistic 1 0(?: perl)? | artistic licen[sc]e(?: version)? 1 0
artistic-2.0 | artistic 2 0 | artistic licen[sc]e(?: version)? 2 0
afl-3.0 | afl 3 0 | academic free licen[sc]e(?: version| v)?(?: 3 0)?
osl-3.0 | osl 3 0 | open software licen[sc]e(?: version| v)?(?: 3 0)?
ecl-2.0 | ecl 2 0 | educational community licen[sc]e(?: version)?(?: 2 0)?
ms-pl | ms pl | microsoft public licen[sc]e
ms-rl | ms rl | microsoft reciprocal licen[sc]e
gpl-1.0 | gpl 1 0(?: only| or later)? | (?:gnu )?(?:general public licen[sc]e|gpl)(?: version| v)?(?: 1| v1)(?: 0)?
gpl-2.0 | gpl 2 0(?: only| or later)? | (?:gnu )?(?:general public licen[sc]e|gpl|gplv2)(?: version| v)?(?: 2| v2)(?: 0)?
gpl-3.0 | gpl 3 0(?: only| or later)? | (?:gnu )?(?:general public licen[sc]e|gpl|gplv3)(?: version| v)?(?: 3| v3)(?: 0)?
lgpl-2.0 | lgpl 2 0(?: only| or later)? | (?:gnu )?(?:library general public licen[sc]e|lgpl)(?: version| v)?(?: 2| v2) 0
lgpl-2.1 | lgpl 2 1(?: only| or later)? | (?:gnu )?(?:lesser general public licen[sc]e|lgpl)(?: version| v)?(?: 2| v2) 1
lgpl-3.0 | lgpl 3 0(?: only| or later)? | (?:gnu )?(?:lesser general public licen[sc]e|lgpl)(?: version| v)?(?: 3| v3)(?: 0)?
agpl-3.0 | agpl 3 0(?: only| or later)? | (?:gnu )?(?:affero general public licen[sc]e|agpl|agplv3)(?: version| v)?(?: 3| v3)?(?: 0)?
gfdl-1.3 | gfdl 1 3(?: only| or later)? | (?:gnu )?free documentation licen[sc]e(?: version)?(?: 1 3)?
mpl-1.1 | mpl 1 1 | mozilla public licen[sc]e(?: version| v)? 1 1
mpl-2.0 | mpl 2 0 | mozilla public licen[sc]e(?: version| v)?(?: 2 0)?
epl-1.0 | epl 1 0 | eclipse public licen[sc]e(?: version| v)? 1 0
epl-2.0 | epl 2 0 | eclipse public licen[sc]e(?: version| v)?(?: 2 0)?
edl-1.0 | edl 1 0 | eclipse distribution licen[sc]e(?: version| v)?(?: 1 0)?
cddl-1.0 | cddl 1 0 | common development and distribution licen[sc]e(?: version)?(?: 1 0)?
cpl-1.0 | cpl 1 0 | common public licen[sc]e(?: version)?(?: 1 0)?
ipl-1.0 | ipl 1 0 | ibm public licen[sc]e(?: version)?(?: 1 0)?
eupl-1.2 | eupl 1 2 | european union public licen[sc]e(?: version| v)?(?: 1 2)?
cecill-2.1 | cecill 2 1 | cecill(?: free software)? licen[sc]e(?: agreement)?
qpl-1.0 | qpl 1 0 | q public licen[sc]e
sspl-1.0 | sspl 1 0 | server side public licen[sc]e(?: version| v)?(?: 1)?
busl-1.1 | busl 1 1 | business source licen[sc]e(?: version)?(?: 1 1)?
elastic-2.0 | elastic 2 0 | elastic licen[sc]e(?: version)?(?: 2 0)?
ofl-1.1 | ofl 1 1 | (?:sil )?open font licen[sc]e(?: version)?(?: 1 1)?
odbl-1.0 | odbl 1 0 | open (?:data commons open )?database licen[sc]e
odc-by-1.0 | odc by 1 0 | open data commons attribution licen[sc]e
pddl-1.0 | pddl 1 0 | (?:open data commons )?public domain dedication and licen[sc]e
ogl-uk-3.0 | ogl uk 3 0 | open government licen[sc]e(?: version| v)?(?: 3 0)?
cc0-1.0 | cc0 1 0 | (?:creative commons (?:zero|cc0)|cc0)(?: 1 0)?(?: universal)?(?: public domain dedication| licen[sc]e)
cc-by | cc by ~ 0 | (?:creative commons attribution|cc by)(?: ~ 0)?(?: international| unported)? licen[sc]e
cc-by-sa | cc by sa ~ 0 | (?:creative commons attribution share ?alike|cc by sa)(?: ~ 0)?(?: international| unported)? licen[sc]e
cc-by-nc | cc by nc ~ 0 | (?:creative commons attribution non ?commercial|cc by nc)(?: ~ 0)?(?: international| unported)? licen[sc]e
cc-by-nd | cc by nd ~ 0 | (?:creative commons attribution no ?deriv(?:ative|atives|s)|cc by nd)(?: ~ 0)?(?: international| unported)? licen[sc]e
cc-by-nc-sa | cc by nc sa ~ 0 | (?:creative commons attribution non ?commercial share ?alike|cc by nc sa)(?: ~ 0)?(?: international| unported)? licen[sc]e
cc-by-nc-nd | cc by nc nd ~ 0 | (?:creative commons attribution non ?commercial no ?deriv(?:ative|atives|s)|cc by nc nd)(?: ~ 0)?(?: international| unported)? licen[sc]e
"""

#: Rules of their own by class, label, keyword, pattern.
OTHERS = """
2 | mit | permission | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
2 | isc | permission | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
2 | ncsa | permission | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal with the software
2 | bsd-2-clause | redistribut | redistribution and use in source and binary forms with or without modification are permitted
2 | bsd-3-clause | permission | may be used to endorse or promote products derived from this software without specific prior written permission
2 | bsd-4-clause | software | redistributions?(?: ~){0,30} all advertising materials mentioning features or use of this software
2 | apache-2.0 | compliance | you may not use this file except in compliance with the licen[sc]e
2 | apache-2.0 | licenses | a copy of the licen[sc]e at http www apache org licenses license 2 0
2 | gpl-2.0 | redistribut | you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e as published by the free software foundation either version 2
2 | gpl-3.0 | redistribut | you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e as published by the free software foundation either version 3
2 | lgpl-2.1 | redistribut | you can redistribute it and or modify it under the terms of the gnu lesser general public licen[sc]e as published by the free software foundation either version 2 1
2 | lgpl-3.0 | redistribut | you can redistribute it and or modify it under the terms of the gnu lesser general public licen[sc]e as published by the free software foundation either version 3
2 | agpl-3.0 | redistribut | you can redistribute it and or modify it under the terms of the gnu affero general public licen[sc]e
2 | gpl | gnu | you should have received a copy of the gnu general public licen[sc]e
2 | lgpl | gnu | you should have received a copy of the gnu lesser general public licen[sc]e
2 | agpl-3.0 | gnu | you should have received a copy of the gnu affero general public licen[sc]e
2 | gfdl-1.3 | permission | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[sc]e
2 | mpl-2.0 | mozilla | this source code form is subject to the terms of the mozilla public licen[sc]e v 2 0
2 | zlib | permission | permission is granted to anyone to use this software for any purpose including commercial applications
2 | bsl-1.0 | permission | permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this licen[sc]e
2 | unlicense | domain | this is free and unencumbered software released into the public domain
2 | postgresql | permission | permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
2 | epl-2.0 | eclipse | made available under the terms of the eclipse public licen[sc]e 2 0
2 | epl-1.0 | eclipse | made available under the terms of the eclipse public licen[sc]e v1 0
2 | cddl-1.0 | development | subject to the terms of the common development and distribution licen[sc]e
2 | ofl-1.1 | font | this font software is licen[sc]ed under the sil open font licen[sc]e
2 | wtfpl | licen | everyone is permitted to copy and distribute verbatim or modified copies of this licen[sc]e document and changing it is allowed
2 | ms-pl | licen | this licen[sc]e governs use of the accompanying software
2 | bsd-disclaimer | warrant | this software is provided by(?: ~){1,8} as is and any express or implied warranties
2 | mit | warrant | the software is provided as is without warranty of any kind express or implied
2 | gpl | warrant | this program is distributed in the hope that it will be useful but without any warranty
2 | no-warranty | warrant | there is no warranty for the program to the extent permitted by applicable law
2 | cc-by-4.0 | creativecommons | creativecommons org licenses by 4 0
2 | cc-by-sa-4.0 | creativecommons | creativecommons org licenses by sa 4 0
2 | cc-by-nc-4.0 | creativecommons | creativecommons org licenses by nc 4 0
2 | cc-by-nd-4.0 | creativecommons | creativecommons org licenses by nd 4 0
2 | cc-by-nc-sa-4.0 | creativecommons | creativecommons org licenses by nc sa 4 0
2 | cc-by-nc-nd-4.0 | creativecommons | creativecommons org licenses by nc nd 4 0
2 | cc0-1.0 | creativecommons | creativecommons org publicdomain zero 1 0
3 | cc-by-4.0 | licen | licen[sc]ed under(?: a| the)? (?:creative commons attribution|cc by) 4 0
3 | cc-by-sa-4.0 | licen | licen[sc]ed under(?: a| the)? (?:creative commons attribution share ?alike|cc by sa) 4 0
3 | cc-by-nc-4.0 | licen | licen[sc]ed under(?: a| the)? (?:creative commons attribution non ?commercial|cc by nc) 4 0
3 | cc-by-nd-4.0 | licen | licen[sc]ed under(?: a| the)? (?:creative commons attribution no ?deriv(?:ative|atives|s)|cc by nd) 4 0
3 | cc-by-nc-sa-4.0 | licen | licen[sc]ed under(?: a| the)? (?:creative commons attribution non ?commercial share ?alike|cc by nc sa) 4 0
3 | cc-by-nc-nd-4.0 | licen | licen[sc]ed under(?: a| the)? (?:creative commons attribution non ?commercial no ?deriv(?:ative|atives|s)|cc by nc nd) 4 0
3 | gpl-2.0-or-later | gpl | (?:gpl|gplv2)(?: version)? ?(?:2|v2)?(?: 0)? or (?:any )?later
3 | public-domain | domain | (?:released|placed|dedicated|put) (?:in|into|to) the public domain
3 | public-domain | domain | (?:is|are) in the public domain
3 | public-domain | domain | gemeinfrei(?: ~){0,3} public domain
4 | apache | apache | apache (?:software )?licen[sc]e
4 | gpl | gnu | gnu general public licen[sc]e
4 | gpl | licen | general public licen[sc]e
4 | lgpl | licen | lesser general public licen[sc]e
4 | bsd | bsd | bsd(?: style| like)? licen[sc]e
4 | artistic | artistic | artistic licen[sc]e
4 | creative-commons | commons | creative commons licen[sc]e
4 | cc0-1.0 | domain | cc0(?: ~){0,2} public domain
5 | all-rights-reserved | reserved | all rights reserved
5 | all-rights-reserved | vorbehalten | alle rechte vorbehalten
5 | all-rights-reserved | reservados | todos los derechos reservados
5 | all-rights-reserved | droits | tous droits réservés
5 | some-rights-reserved | reserved | some rights reserved
5 | copyright | copyright | copyright(?: c)?(?: [0-9]{4}){1,3}
5 | copyright | copyright | ©(?: copyright)?(?: [0-9]{4}){1,3} copyright
5 | proprietary | proprietary | (?:proprietary and confidential|confidential and proprietary)
5 | proprietary | permission | without (?:the )?(?:prior |express |written )+(?:consent or )?permission
5 | proprietary | licen | end user licen[sc]e agreement
5 | proprietary | commercial | (?:under|requires) a commercial licen[sc]e
5 | dual-license | licen | dual licen[sc]ed
5 | copyleft | copyleft | (?:strong |weak )?copyleft
5 | unknown-license | licen | (?:licen[sc]ed|sublicen[sc]ed) under
5 | unknown-license | licen | see(?: the)? licen[sc]e(?: ~)? file
5 | unknown-license | licen | (?:terms and conditions|terms) of(?: the| this| a)? licen[sc]e
5 | unknown-license | licen | released under(?: ~){1,4} licen[sc]e
5 | unknown-license | licen | this licen[sc]e
5 | unknown-license | lizenz | (?:lizenziert unter|unter der lizenz)
5 | unknown-license | licen | (?:sous licence|bajo licencia|bajo la licencia)
"""

#: The words one of which stands in whatever a rule matches: texts without any are not scanned.
ROOTS = ("licen", "lizenz", "spdx", "copyright", "copyleft", "permission", "redistribut", "warrant", "domain", "commons", "gpl", "reserved", "vorbehalten", "reservados", "droits", "proprietary")

#: Classes from the best to the last: tags, sentences of a notice, grants with a name, names, mentions; and how sure each makes.
SURENESS = (1.0, 0.95, 0.9, 0.75, 0.5)


@dataclass(frozen=True)
class LicenseRule:
    """``rank`` is a class from 1; ``keyword`` stands in every match, within a word (empty: any text will do)."""

    rank: int
    label: str
    keyword: str
    pattern: str


def _longest_word(name: str) -> str:
    """The longest word that each match of a name has, of what stands outside of groups; empty if nothing does."""
    bare, depth = "", 0
    for k, c in enumerate(name):
        depth += (c == "(") - (c == ")")
        bare += " " if depth or c in ")[]?" or name[k + 1 : k + 2] == "?" else c
    words = [w for w in bare.split() if w.isalnum() and w not in ("e", "sc")]
    return max(words, key=len, default="")


def built_in() -> tuple[LicenseRule, ...]:
    """Each family as a tag, a grant and a name, then the rules of their own."""
    found = []
    for line in FAMILIES.strip().splitlines():
        label, tag, name = (x.strip() for x in line.split(" | "))
        keyword = _longest_word(name)
        found.append(LicenseRule(1, label, "spdx", f"spdx licen[sc]e identifier {tag}"))
        found.append(LicenseRule(3, label, keyword, f"(?:licen[sc]ed|released|distributed|available|provided|published|shared|covered)(?: ~){{0,3}} (?:under|by)(?: the)?(?: terms of)?(?: the| a)? {name}"))
        found.append(LicenseRule(4, label, keyword, name))
    for line in OTHERS.strip().splitlines():
        rank, label, keyword, pattern = (x.strip() for x in line.split(" | "))
        found.append(LicenseRule(int(rank), label, keyword, pattern))
    return tuple(found)


RULES = built_in()

#: The labels of phrases that count in any case.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}


def on_places(pattern: str) -> str:
    """The pattern for texts whose words carry their places, as in `` mit#7 license#8``."""
    return " " + pattern.replace(" ?", "(?: |)").replace(" ", "#[0-9]+ ").replace("~", "[^ #]+") + "#[0-9]+"
