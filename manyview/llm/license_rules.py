"""Signature rules for license mentions, written by hand.

A rule is a pattern over a text's words (lower case letters and digits, one space
between), with the label it gives, the keyword without which it cannot match, a
priority and a confidence. Patterns are of bounded length: none matches more than
``MOST_WORDS`` words. Kinds of rules differ in what they are evidence of: a machine-read
identifier says more than a notice, a notice more than a title, a title more than a name.
"""

from __future__ import annotations

from dataclasses import dataclass

#: Words that a signature may match, at most.
MOST_WORDS = 64
# Kinds of rules, with priority and confidence.
KINDS: dict[str, tuple[int, float]] = {
    "identifier": (100, 1.0),
    "address": (95, 1.0),
    "notice": (90, 1.0),
    "clause": (85, 0.95),
    "grant": (80, 0.95),
    "title": (60, 0.85),
    "name": (50, 0.7),
    "hint": (20, 0.3),
}
# The signatures, as kind, label, keyword and pattern.
SIGNATURES = r"""
identifier | mit | spdx | spdx license identifier mit(?: 0)?
identifier | apache-2.0 | spdx | spdx license identifier apache 2 0
identifier | gpl-2.0 | spdx | spdx license identifier gpl 2 0(?: only| or later)?
identifier | gpl-3.0 | spdx | spdx license identifier gpl 3 0(?: only| or later)?
identifier | lgpl-2.1 | spdx | spdx license identifier lgpl 2 1(?: only| or later)?
identifier | lgpl-3.0 | spdx | spdx license identifier lgpl 3 0(?: only| or later)?
identifier | agpl-3.0 | spdx | spdx license identifier agpl 3 0(?: only| or later)?
identifier | bsd-2-clause | spdx | spdx license identifier bsd 2 clause(?: patent)?
identifier | bsd-3-clause | spdx | spdx license identifier bsd 3 clause(?: clear)?
identifier | 0bsd | spdx | spdx license identifier 0bsd
identifier | mpl-2.0 | spdx | spdx license identifier mpl 2 0
identifier | epl-2.0 | spdx | spdx license identifier epl [12] 0
identifier | isc | spdx | spdx license identifier isc
identifier | zlib | spdx | spdx license identifier zlib
identifier | unlicense | spdx | spdx license identifier unlicense
identifier | cc0 | spdx | spdx license identifier cc0 1 0
identifier | cc-by | spdx | spdx license identifier cc by [1-4] [05]
identifier | cc-by-sa | spdx | spdx license identifier cc by sa [1-4] [05]
identifier | cc-by-nc | spdx | spdx license identifier cc by nc(?: sa| nd)? [1-4] [05]
identifier | bsl-1.0 | spdx | spdx license identifier bsl 1 0
identifier | wtfpl | spdx | spdx license identifier wtfpl
identifier | artistic-2.0 | spdx | spdx license identifier artistic [12] 0
identifier | ofl-1.1 | spdx | spdx license identifier ofl 1 [01]
identifier | eupl-1.2 | spdx | spdx license identifier eupl 1 [12]
identifier | postgresql | spdx | spdx license identifier postgresql
identifier | python-2.0 | spdx | spdx license identifier (?:python|psf) 2 0
identifier | ncsa | spdx | spdx license identifier ncsa
identifier | blueoak | spdx | spdx license identifier blueoak 1 0 0
identifier | mit | classifier | classifier license osi approved mit license
identifier | apache-2.0 | classifier | classifier license osi approved apache software license
identifier | bsd | classifier | classifier license osi approved bsd license
identifier | gpl-3.0 | classifier | classifier license osi approved gnu general public license v3(?: or later)?(?: gplv3)?
identifier | mpl-2.0 | classifier | classifier license osi approved mozilla public license 2 0(?: mpl 2 0)?
identifier | mit | license | license (?:= )?mit or apache 2 0
identifier | mit | module_license | module_license mit
identifier | gpl | module | module license (?:dual (?:mit|bsd) )?gpl(?: v2)?
address | apache-2.0 | apache | apache org licenses license 2 0(?: txt| html)?
address | apache-1.1 | apache | apache org licenses license 1 1
address | mit | opensource | opensource org licenses? mit(?: license)?(?: php)?
address | bsd-2-clause | opensource | opensource org licenses? bsd 2 clause
address | bsd-3-clause | opensource | opensource org licenses? bsd 3 clause
address | bsd | opensource | opensource org licenses? bsd license(?: php)?
address | isc | opensource | opensource org licenses? isc(?: license)?
address | gpl-2.0 | gnu | gnu org licenses (?:old licenses )?gpl 2 0(?: txt| html| en html)?
address | gpl-3.0 | gnu | gnu org licenses gpl 3 0(?: txt| html| en html)?
address | gpl | gnu | gnu org (?:licenses|copyleft) gpl(?: txt| html| en html)?
address | lgpl | gnu | gnu org (?:licenses|copyleft) (?:old licenses )?(?:lgpl|lesser)(?: [23] [01])?(?: txt| html)?
address | agpl-3.0 | gnu | gnu org licenses agpl(?: 3 0)?(?: txt| html)?
address | fdl | gnu | gnu org (?:licenses|copyleft) fdl(?: 1 [123])?(?: txt| html)?
address | mpl-2.0 | mozilla | mozilla org mpl 2 0
address | mpl-1.1 | mozilla | mozilla org mpl(?: mpl)? 1 1(?: html)?
address | epl | eclipse | eclipse org legal epl (?:v10|v20|2 0)(?: html)?
address | cc0 | creativecommons | creativecommons org publicdomain zero 1 0
address | public-domain | creativecommons | creativecommons org publicdomain mark 1 0
address | cc-by | creativecommons | creativecommons org licenses by [1-4] [05]
address | cc-by-sa | creativecommons | creativecommons org licenses by sa [1-4] [05]
address | cc-by-nc | creativecommons | creativecommons org licenses by nc [1-4] [05]
address | cc-by-nc-sa | creativecommons | creativecommons org licenses by nc sa [1-4] [05]
address | cc-by-nc-nd | creativecommons | creativecommons org licenses by nc nd [1-4] [05]
address | cc-by-nd | creativecommons | creativecommons org licenses by nd [1-4] [05]
address | unlicense | unlicense | (?:http|https) unlicense org
address | wtfpl | wtfpl | wtfpl net(?: about)?
address | bsl-1.0 | boost | boost org license 1 0(?: txt)?
address | ofl-1.1 | sil | scripts sil org(?: ofl)?
address | ofl-1.1 | openfontlicense | openfontlicense org(?: ofl)?
address | odbl | opendatacommons | opendatacommons org licenses (?:odbl|by|pddl)(?: 1 0)?
address | php | php | php net license 3 01?(?: txt)?
address | artistic | perlfoundation | perlfoundation org (?:legal licenses )?artistic(?: license)? 2 0
address | zlib | zlib | zlib net zlib license(?: html)?
address | cddl | sun | sun com cddl(?: cddl)?(?: html)?
address | polyform | polyformproject | polyformproject org licenses (?:noncommercial|small business|shield|strict) 1 0 0
notice | mit | permission | permission is hereby granted free of charge to any person obtaining a copy(?: of this software and associated documentation files)?(?: the software)?
notice | mit | permission | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
notice | x11 | consortium | except as contained in this notice the name of the x consortium shall not be used in advertising
notice | isc | permission | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
notice | isc | permission | permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted
notice | hpnd | permission | permission to use copy modify and distribute this software and its documentation for any purpose (?:and )?without fee is hereby granted
notice | 0bsd | permission | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is
notice | bsd | redistribution | redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
notice | bsd-3-clause | neither | neither the name of (?:\S+ ){1,12}?nor the names of its contributors may be used to endorse or promote products
notice | bsd-4-clause | advertising | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
notice | bsd | redistributions | redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
notice | bsd | redistributions | redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer
notice | apache-2.0 | apache | licensed under the apache license version 2 0(?: the license)?
notice | apache-2.0 | compliance | you may not use this file except in compliance with the license
notice | apache-2.0 | licensed | licensed to the apache software foundation asf under one or more contributor license agreements
notice | apache-1.1 | apache | this product includes software developed by the apache software foundation
notice | gpl | redistribute | is free software you can redistribute it and or modify it under the terms of the gnu general public license
notice | gpl-2.0 | version | gnu general public license as published by the free software foundation (?:either )?version 2(?: of the license)?
notice | gpl-3.0 | version | gnu general public license as published by the free software foundation (?:either )?version 3(?: of the license)?
notice | lgpl | redistribute | is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license
notice | agpl-3.0 | redistribute | is free software you can redistribute it and or modify it under the terms of the gnu affero general public license
notice | lgpl-2.1 | lesser | gnu lesser general public license as published by the free software foundation (?:either )?version 2 1
notice | gpl | received | you should have received a copy of the gnu general public license along with this (?:program|file|software|library)
notice | lgpl | received | you should have received a copy of the gnu (?:lesser|library) general public license along with this (?:program|library)
notice | agpl-3.0 | received | you should have received a copy of the gnu affero general public license along with this program
notice | fdl | document | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
notice | mpl-2.0 | mozilla | this source code form is subject to the terms of the mozilla public license v 2 0
notice | mpl-1.1 | mozilla | the contents of this file are subject to the mozilla public license version 1 1
notice | epl | eclipse | this program and the accompanying materials are made available under the terms of the eclipse public license
notice | cddl | development | the contents of this file are subject to the terms of the common development and distribution license
notice | zlib | origin | the origin of this software must not be misrepresented you must not claim that you wrote the original software
notice | zlib | altered | altered source versions must be plainly marked as such and must not be misrepresented as being the original software
notice | unlicense | unencumbered | this is free and unencumbered software released into the public domain
notice | cc0 | waived | to the extent possible under law (?:\S+ ){1,12}?has waived all copyright and related or neighboring rights
notice | wtfpl | fuck | (?:you just )?do what the fuck you want to(?: public license)?
notice | bsl-1.0 | boost | distributed under the boost software license version 1 0
notice | postgresql | permission | permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
notice | openssl | openssl | this product includes software developed by the openssl project for use in the openssl toolkit
notice | openssl | cryptographic | this product includes cryptographic software written by eric young
notice | php | php | this product includes php software freely available from
notice | python-2.0 | psf | psf hereby grants licensee a nonexclusive royalty free world ?wide license
notice | ofl-1.1 | font | this font software is licensed under the sil open font license version 1 1
notice | artistic | package | the intent of this document is to state the conditions under which a package may be copied
notice | busl-1.1 | non production | the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work
notice | sspl | service | if you make the functionality of the program or a modified version available to third parties as a service
notice | elastic-2.0 | hosted | you may not provide the software to third parties as a hosted or managed service
notice | commons-clause | sell | the grant of rights under the license will not include and the license does not grant to you the right to sell the software
notice | json | evil | the software shall be used for good not evil
notice | beerware | beer | if we meet some day and you think this stuff is worth it you can buy me a beer
notice | ms-pl | accept this license | if you use the software you accept this license if you do not accept the license do not use the software
notice | curl | permission | permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice
notice | ncsa | contributors | neither the names of (?:\S+ ){1,12}?nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission
notice | odbl | database | this (?:\S+ ){1,6}?is made available under the open database license
notice | cc-by | work | this work is licensed under (?:a|the) creative commons attribution(?: [1-4] [05])?(?: international| unported| generic)? license
notice | cc-by-sa | work | this work is licensed under (?:a|the) creative commons attribution share ?alike(?: [1-4] [05])?(?: international| unported| generic)? license
notice | cc-by-nc | work | this work is licensed under (?:a|the) creative commons attribution non ?commercial(?: share ?alike| no ?deriv(?:s|atives))?(?: [1-4] [05])?(?: international| unported| generic)? license
clause | mit | warranty | the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability
clause | bsd | implied warranties | this software is provided by the (?:copyright holders|authors?|regents|contributors)(?: and contributors)? as is and any express or implied warranties
clause | gpl | warranty | but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose
clause | apache-2.0 | unless | unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
clause | zlib | warranty | this software is provided as is without any express or implied warranty in no event will the authors be held liable
clause | unlicense | dedication | we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors
clause | apache-2.0 | perpetual | hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable (?:copyright|patent) license
clause | gpl-3.0 | propagate | to propagate a work means to do anything with it that without permission would make you directly or secondarily liable
clause | gpl-2.0 | freedom | the licenses for most software are designed to take away your freedom to share and change it
clause | agpl-3.0 | network | interacting with it remotely through a computer network if your version supports such interaction
clause | lgpl | library | a work that uses the library in isolation is not a derivative work of the library
clause | mpl-2.0 | covered | covered software is provided under this license on an as is basis without warranty of any kind
clause | epl | recipient | a recipient s patent rights granted under (?:section 2 b|this agreement) shall terminate
clause | cc-by | appropriate credit | you must give appropriate credit provide a link to the license and indicate if changes were made
clause | cc-by-sa | contributions | if you remix transform or build upon the material you must distribute your contributions under the same license
clause | cc-by-nc | commercial | you may not use the material for commercial purposes
clause | cc-by-nd | remix | if you remix transform or build upon the material you may not distribute the modified material
clause | artistic | verbatim | you may make and give away verbatim copies of the source form of the standard version of this package without restriction
clause | ofl-1.1 | font | the font software may be sold as part of a larger software package but no copy of one or more of the font software
clause | eupl-1.2 | european | the european union public licence applies to the work
clause | proprietary | confidential | (?:is )?(?:proprietary and confidential|confidential and proprietary)(?: information)?
clause | proprietary | prohibited | unauthorized copying of this file via any medium is strictly prohibited
clause | proprietary | reproduced | no part of this (?:publication|document|book|software|work) may be reproduced(?: stored| distributed| or transmitted){0,3}
clause | proprietary | reverse | you may not reverse engineer decompile or disassemble
grant | mit | mit | (?:released|licensed|distributed|available|provided|published|covered) (?:under|by) (?:the )?(?:terms of )?(?:the )?(?:mit|mit x11) licen[sc]e
grant | mit | expat | (?:released|licensed|distributed|available|provided|published|covered) (?:under|by) (?:the )?(?:terms of )?(?:the )?expat licen[sc]e
grant | apache-2.0 | apache | (?:released|licensed|distributed|available|provided|published|covered) (?:under|by) (?:the )?(?:terms of )?(?:the )?apache(?: software)? licen[sc]e(?: version)?(?: v)? ?2(?: 0)?
grant | apache | apache | (?:released|licensed|distributed|available|provided|published|covered) (?:under|by) (?:the )?(?:terms of )?(?:the )?apache(?: software)? licen[sc]e
grant | gpl | general public | (?:released|licensed|distributed|available|provided|published|covered) (?:under|by) (?:the )?(?:terms of )?(?:the )?(?:gnu )?general public licen[sc]e
grant | gpl | gpl | (?:released|licensed|distributed|available|provided|published|covered) (?:under|by) (?:the )?(?:terms of )?(?:the )?(?:gnu )?gpl(?:v[23])?
grant | lgpl | lgpl | (?:released|licensed|distributed|available|provided|published|covered) (?:under|by) (?:the )?(?:terms of )?(?:the )?(?:gnu )?lgpl(?:v[23])?
grant | agpl | agpl | (?:released|licensed|distributed|available|provided|published|covered) (?:under|by) (?:the )?(?:terms of )?(?:the )?(?:gnu )?agpl(?:v3)?
grant | bsd | bsd | (?:released|licensed|distributed|available|provided|published|covered) (?:under|by) (?:the |a )?(?:terms of )?(?:the )?(?:[234] clause |new |modified |simplified )?bsd(?: style)? licen[sc]e
grant | mpl | mozilla | (?:released|licensed|distributed|available|provided|published|covered) (?:under|by) (?:the )?(?:terms of )?(?:the )?mozilla public licen[sc]e
grant | isc | isc | (?:released|licensed|distributed|available|provided|published|covered) (?:under|by) (?:the )?(?:terms of )?(?:the )?isc licen[sc]e
grant | cc | creative commons | (?:released|licensed|distributed|available|provided|published|covered) (?:under|by) (?:a |the )?(?:terms of )?(?:the )?creative commons
grant | public-domain | public domain | (?:released|placed|dedicated|donated) (?:in|into|to) the public domain
grant | dual | dual | (?:is )?dual licensed under(?: the)?
grant | gpl | same terms | under the same terms as perl itself
title | mit | mit | (?:the )?(?:mit|mit x11) licen[sc]e
title | mit | expat | (?:the )?expat licen[sc]e
title | apache-2.0 | apache | apache(?: software)? licen[sc]e(?: version)?(?: v)? ?2(?: 0)?
title | apache | apache | (?:the )?apache(?: software)? licen[sc]e
title | gpl-2.0 | general public | (?:gnu )?general public licen[sc]e(?: version| v)? ?2(?: 0)?
title | gpl-3.0 | general public | (?:gnu )?general public licen[sc]e(?: version| v)? ?3(?: 0)?
title | gpl | general public | (?:gnu )?general public licen[sc]e
title | lgpl | general public | (?:gnu )?(?:lesser|library) general public licen[sc]e(?: version| v)?(?: [23](?: [01])?)?
title | agpl | general public | (?:gnu )?affero general public licen[sc]e(?: version| v)?(?: 3(?: 0)?)?
title | fdl | free documentation | (?:gnu )?free documentation licen[sc]e(?: version)?(?: 1 [123])?
title | bsd-2-clause | bsd | (?:(?:2|two) clause|simplified|freebsd) bsd licen[sc]e
title | bsd-2-clause | bsd | bsd (?:2|two) clause(?: simplified)?(?: licen[sc]e)?
title | bsd-3-clause | bsd | (?:(?:3|three) clause|new|modified|revised) bsd licen[sc]e
title | bsd-3-clause | bsd | bsd (?:3|three) clause(?: new| revised)?(?: licen[sc]e)?
title | bsd-4-clause | bsd | (?:(?:4|four) clause|original|old) bsd licen[sc]e
title | bsd | bsd | bsd(?: style)? licen[sc]e
title | mpl-2.0 | mozilla | mozilla public licen[sc]e(?: version)?(?: v)? ?2(?: 0)?
title | mpl | mozilla | mozilla public licen[sc]e(?: version)?(?: 1 [01])?
title | epl | eclipse | eclipse public licen[sc]e(?: version| v)?(?: [12] 0)?
title | cddl | distribution | common development and distribution licen[sc]e(?: version)?(?: 1 [01])?
title | cpl | common | common public licen[sc]e(?: version)?(?: 1 0)?
title | isc | isc | (?:the )?isc licen[sc]e
title | zlib | zlib | zlib(?: libpng)? licen[sc]e
title | bsl-1.0 | boost | boost software licen[sc]e(?: version)?(?: 1 0)?
title | artistic-2.0 | artistic | artistic licen[sc]e(?: version)? 2 0
title | artistic | artistic | (?:the )?artistic licen[sc]e
title | unlicense | unlicense | the unlicense
title | wtfpl | what the | do what the \S+ you want to public licen[sc]e
title | ofl-1.1 | font | (?:sil )?open font licen[sc]e(?: version)?(?: 1 1)?
title | eupl | european | european union public licen[sc]e(?: version| v)?(?: 1 [12])?
title | python-2.0 | python | python(?: software foundation)? licen[sc]e(?: version)?(?: 2(?: 0)?)?
title | php | php | php licen[sc]e(?: version)?(?: 3(?: 01?)?)?
title | ruby | ruby | ruby (?:s )?licen[sc]e
title | postgresql | postgresql | postgresql licen[sc]e
title | openssl | openssl | openssl licen[sc]e
title | odbl | open | open (?:data commons )?(?:open )?database licen[sc]e(?: v)?(?: 1 0)?
title | pddl | public domain | public domain dedication and licen[sc]e
title | ms-pl | microsoft | microsoft public licen[sc]e
title | ms-rl | microsoft | microsoft reciprocal licen[sc]e
title | ncsa | ncsa | (?:university of illinois )?ncsa(?: open source)? licen[sc]e
title | afl-3.0 | academic | academic free licen[sc]e(?: version| v)?(?: [123] [012])?
title | osl-3.0 | open | open software licen[sc]e(?: version| v)?(?: [123] [01])?
title | upl-1.0 | permissive | universal permissive licen[sc]e(?: v)?(?: 1 0)?
title | sspl | server side | server side public licen[sc]e(?: version| v)?(?: 1)?
title | busl-1.1 | business | business source licen[sc]e(?: version)?(?: 1 [01])?
title | elastic-2.0 | elastic | elastic licen[sc]e(?: version| v)?(?: 2(?: 0)?)?
title | rpl-1.5 | reciprocal | reciprocal public licen[sc]e(?: version)?(?: 1 [15])?
title | qpl | public | q public licen[sc]e(?: version)?(?: 1 0)?
title | cecill | cecill | cecill(?: [bc])?(?: free software)?(?: licen[sc]e)?(?: agreement)?
title | vim | vim | vim licen[sc]e
title | intel | intel | intel (?:open source|simplified software) licen[sc]e
title | nvidia | nvidia | nvidia (?:source code|software) licen[sc]e
title | openrail | rail | (?:creativeml |bigscience |big code )?open ?rail(?: [md])? licen[sc]e
title | openrail | responsible ai | (?:creativeml |bigscience |big code )?responsible ai(?: [md])? licen[sc]e
title | llama | llama | llama [23](?: [0-9])? community licen[sc]e(?: agreement)?
title | cc-by-sa | creative | creative commons attribution share ?alike(?: licen[sc]e)?(?: [1-4] [05])?
title | cc-by-nc | creative | creative commons attribution non ?commercial(?: share ?alike| no ?deriv(?:s|atives))?(?: licen[sc]e)?(?: [1-4] [05])?
title | cc-by-nd | creative | creative commons attribution no ?deriv(?:s|atives)(?: licen[sc]e)?(?: [1-4] [05])?
title | cc-by | creative | creative commons attribution(?: licen[sc]e)?(?: [1-4] [05])?
title | cc0 | creative | creative commons zero(?: licen[sc]e)?(?: 1 0)?
name | cc0 | cc0 | cc0(?: 1 0)?
name | gpl-2.0 | gpl | (?:gnu )?gpl ?v? ?2(?: 0)?(?: only| or later)?
name | gpl-3.0 | gpl | (?:gnu )?gpl ?v? ?3(?: 0)?(?: only| or later)?
name | gpl | gpl | gnu gpl
name | lgpl | lgpl | (?:gnu )?lgpl(?: ?v? ?[23](?: [01])?)?
name | agpl | agpl | (?:gnu )?agpl(?: ?v? ?3(?: 0)?)?
name | proprietary | proprietary | proprietary licen[sc]e
name | commercial | commercial | commercial licen[sc]e(?: agreement)?
name | eula | end user | end user licen[sc]e agreement
name | open-source | open source | open source licen[sc]e
name | mit | licen | licen[sc]ed? (?:is )?mit
name | apache | licen | licen[sc]ed? (?:is )?apache
name | bsd | licen | licen[sc]ed? (?:is )?bsd
name | public-domain | public domain | (?:is )?in the public domain
hint | all-rights-reserved | rights | all rights reserved
hint | copyright | copyright | copyright (?:c )?(?:19|20)\d\d(?: (?:19|20)\d\d)?
hint | copyright | copyright | (?:this|the) (?:work|text|book|article|file) is (?:protected )?(?:by )?copyright(?:ed)?
"""
#: Whatever a rule or a base phrase matches holds one of these, which are looked for in the text as it is.
GATE = (
    "licen gpl spdx copyright permission redistribut contributor domain warrant rights gnu mozilla eclipse scripts perlfoundation cddl wtfpl fuck consortium beer "
    "functionality package misrepresented software confidential derivative remix interacting reproduced prohibited dedication verbatim decompile commercial perl bsd "
    "cecill cc0 creative"
).split()
# Phrases of the contract, with their labels.
BASE: list[tuple[str, str]] = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]


@dataclass(frozen=True)
class Rule:
    label: str
    keyword: str
    pattern: str
    priority: int
    confidence: float


def rules() -> list[Rule]:
    """In order of priority, highest first; ties by pattern, so that the order is fixed."""
    out = []
    for line in SIGNATURES.strip().splitlines():
        kind, label, keyword, pattern = line.split(" | ", 3)
        out.append(Rule(label, keyword, pattern, *KINDS[kind]))
    return sorted(out, key=lambda r: (-r.priority, r.pattern))
