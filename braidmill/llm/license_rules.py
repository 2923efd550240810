"""Signature rules of the license scan, written over lower-cased words with one space between two.

A rule is (keyword, regular expression, priority, label); any match, with the
blank before it, contains the keyword, priority 1 is the highest, and of equal
priorities earlier rules win.
"""

from __future__ import annotations

# Names that licenses go by, with the versions that were published.
NAMED = """
gnu affero general public|agpl|3
affero general public|agpl|1
gnu lesser general public|lgpl|2.1 3
gnu library general public|lgpl|2
gnu general public|gpl|1 2 3
gnu free documentation|gfdl|1.1 1.2 1.3
apache|apache|1.0 1.1 2.0
mozilla public|mpl|1.0 1.1 2.0
netscape public|npl|1.0 1.1
eclipse public|epl|1.0 2.0
eclipse distribution|edl|1.0
european union public|eupl|1.0 1.1 1.2
academic free|afl|1.1 1.2 2.0 2.1 3.0
open software|osl|1.0 1.1 2.0 2.1 3.0
artistic|artistic|1.0 2.0
clarified artistic|clartistic|
boost software|bsl|1.0
common public|cpl|1.0
common public attribution|cpal|1.0
common development and distribution|cddl|1.0 1.1
microsoft public|ms-pl|
microsoft reciprocal|ms-rl|
apple public source|apsl|1.0 1.1 1.2 2.0
zope public|zpl|1.1 2.0 2.1
python software foundation|psf|2
php|php|3.0 3.01
w3c software|w3c|
sil open font|ofl|1.0 1.1
ubuntu font|ufl|1.0
bitstream vera|bitstream-vera|
open database|odbl|1.0
open data commons attribution|odc-by|1.0
community data license agreement permissive|cdla-permissive|1.0 2.0
latex project public|lppl|1.0 1.1 1.2 1.3 1.3a 1.3c
universal permissive|upl|1.0
business source|busl|1.0 1.1
server side public|sspl|1
elastic|elastic|2.0
cecill|cecill|1.0 1.1 2.0 2.1
q public|qpl|1.0
ibm public|ipl|1.0
lucent public|lpl|1.0 1.02
intel open source|intel|
nokia open source|nokia|1.0a
sun public|spl|1.0
sun industry standards source|sissl|1.1 1.2
ricoh source code public|rscpl|1.0
realnetworks public source|rpsl|1.0
reciprocal public|rpl|1.1 1.5
motosoto|motosoto|0.9.1
sleepycat|sleepycat|
sugarcrm public|sugarcrm|1.1.3
vovida software|vsl|1.0
watcom|watcom|1.0
xnet|xnet|
mulan permissive software|mulan|1 2
blue oak model|blueoak|1.0.0
unicode|unicode|
zlib|zlib|
libpng|libpng|2.0
isc|isc|
mit|mit|
mit no attribution|mit-0|
x11|x11|
expat|mit|
openssl|openssl|
openldap public|oldap|2.7 2.8
vim|vim|
ruby|ruby|
postgresql|postgresql|
curl|curl|
beerware|beerware|
fair|fair|
json|json|
imagemagick|imagemagick|
info zip|info-zip|
university of illinois ncsa open source|ncsa|
educational community|ecl|1.0 2.0
attribution assurance|aal|
adaptive public|apl|1.0
entessa public|entessa|1.0
frameworx|frameworx|1.0
historical permission notice and disclaimer|hpnd|
nethack general public|ngpl|
nasa open source agreement|nasa|1.3
open group test suite|ogtsl|
open public|opl|1.0
non profit open software|nposl|3.0
simple public|simpl|2.0
cryptographic autonomy|cal|1.0
parity public|parity|6.0 7.0
prosperity public|prosperity|3.0
polyform noncommercial|polyform-nc|1.0.0
polyform small business|polyform-sb|1.0.0
hippocratic|hippocratic|2.1
creative ml openrail m|openrail-m|
bigscience openrail m|openrail-m|
llama 2 community|llama2|
""".strip().split("\n")

# Short names: label and the ways in which its letters and number are written.
SHORT = """
agpl|agpl-3|agpl ?v?3(?: 0)?
lgpl|lgpl-2|lgpl ?v?2(?: 0)?
lgpl|lgpl-2.1|lgpl ?v?2 1
lgpl|lgpl-3|lgpl ?v?3(?: 0)?
gpl|gpl-1|gpl ?v?1(?: 0)?
gpl|gpl-2|gpl ?v?2(?: 0)?
gpl|gpl-3|gpl ?v?3(?: 0)?
gfdl|gfdl-1.2|gfdl ?v?1 2
gfdl|gfdl-1.3|gfdl ?v?1 3
mpl|mpl-1.1|mpl ?v?1 1
mpl|mpl-2.0|mpl ?v?2(?: 0)?
epl|epl-1.0|epl ?v?1(?: 0)?
epl|epl-2.0|epl ?v?2(?: 0)?
eupl|eupl-1.2|eupl ?v?1 2
cddl|cddl-1.0|cddl ?v?1(?: 0)?
cddl|cddl-1.1|cddl ?v?1 1
asl|apache-2.0|asl ?v?2(?: 0)?
apache|apache-2.0|apache (?:software foundation )?(?:version )?2(?: 0)?
apache|apache-1.1|apache (?:software foundation )?(?:version )?1 1
""".strip().split("\n")

# Sentences, headers, addresses and tags as they stand in sources: priority, label, keyword, expression.
SIGNATURES = """
2|mit|permission is hereby granted free of charge|permission is hereby granted free of charge to any person obtaining a copy of this software
2|mit|above copyright notice and this permission notice|the above copyright notice and this permission notice (?:including the next paragraph )?shall be included in all copies or substantial portions of the software
3|mit|deal in the software without restriction|to deal in the software without restriction
2|isc|permission to use copy modify|permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee
2|0bsd|with or without fee is hereby granted the software is provided|for any purpose with or without fee is hereby granted the software is provided as is
2|hpnd|permission to use copy modify and distribute this software and its documentation|permission to use copy modify and distribute this software and its documentation for any purpose
2|bsd|redistribution and use in source|redistribution and use in source and binary forms with or without modification are permitted
2|bsd|redistributions of source code must retain|redistributions of source code must retain the above copyright notice
2|bsd|redistributions in binary form must reproduce|redistributions in binary form must reproduce the above copyright notice
1|bsd-3-clause|neither the name|neither the names? of (?:[^ ]+ ){1,20}nor the names of (?:its|their) contributors may be used to endorse or promote products
1|bsd-4-clause|all advertising materials mentioning|all advertising materials mentioning features or use of this software must display the following acknowledge?ment
2|apache-1.1|end user documentation included with the redistribution|the end user documentation included with the redistribution if any must include the following acknowledge?ment
1|apache-2.0|licensed under the apache license version 2|licensed under the apache license version 2(?: 0)? the license
1|apache-2.0|you may not use this file except in compliance with the license|you may not use this file except in compliance with the license you may obtain a copy of the license at
2|apache-2.0|licensed to the apache software foundation|licensed to the apache software foundation asf under one or more contributor license agreements
2|apache-2.0|terms and conditions for use reproduction and distribution|terms and conditions for use reproduction and distribution 1 definitions
2|gpl|free software you can redistribute|free software you can redistribute it and or modify it under the terms of the gnu general public license
2|lgpl|free software you can redistribute|free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license
2|agpl|free software you can redistribute|free software you can redistribute it and or modify it under the terms of the gnu affero general public license
3|gpl|everyone is permitted to copy and distribute verbatim copies|everyone is permitted to copy and distribute verbatim copies of this license document
3|gpl|you should have received a copy of the gnu general public license|you should have received a copy of the gnu general public license along with this program
3|lgpl|you should have received a copy of the gnu lesser general public license|you should have received a copy of the gnu lesser general public license along with this (?:library|program)
3|agpl|you should have received a copy of the gnu affero general public license|you should have received a copy of the gnu affero general public license along with this program
2|gfdl|permission is granted to copy distribute and or modify this document|permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
2|gpl-2-classpath|linking this library statically or dynamically|linking this library statically or dynamically with other modules is making a combined work based on this library
2|gcc-exception|gcc runtime library exception|gcc runtime library exception(?: version 3 1)?
2|llvm-exception|llvm exceptions|apache license v2 0 with llvm exceptions
1|mpl-2.0|this source code form is subject to the terms of the mozilla public license|this source code form is subject to the terms of the mozilla public license v 2 0
2|mpl-1.1|the contents of this file are subject to the mozilla public license|the contents of this file are subject to the mozilla public license version 1 1
2|epl|this program and the accompanying materials are made available|this program and the accompanying materials are made available under the terms of the eclipse public license
2|cddl|the contents of this file are subject to the terms of the common development|the contents of this file are subject to the terms of the common development and distribution license
1|bsl-1.0|boost software license|distributed under the boost software license version 1 0
2|unlicense|unencumbered software|this is free and unencumbered software released into the public domain
2|unlicense|anyone is free to copy modify publish|anyone is free to copy modify publish use compile sell or distribute this software
2|cc0-1.0|to the extent possible under law|to the extent possible under law the (?:author|person who associated cc0)
2|wtfpl|do what the fuck|do what the fuck you want to public license
2|beerware|buy me a beer|you can buy me a beer in return
2|zlib|altered source versions|altered source versions must be plainly marked as such
2|zlib|origin of this software must not be misrepresented|the origin of this software must not be misrepresented
2|openssl|openssl toolkit|this product includes software developed by the openssl project for use in the openssl toolkit
2|ssleay|cryptographic software written by eric young|this product includes cryptographic software written by eric young
2|ofl-1.1|this font software is licensed under|this font software is licensed under the sil open font license version 1 1
2|json|used for good not evil|the software shall be used for good not evil
2|artistic|the intent of this document is to state the conditions|the intent of this document is to state the conditions under which a package may be copied
2|perl|under the same terms as perl|(?:redistribute it and or modify it )?under the same terms as perl itself
2|ruby|you may redistribute it and or modify it under either the terms|you may redistribute it and or modify it under either the terms of the 2 clause bsdl
2|python|psf is making python available|psf is making python available to licensee on an as is basis
2|unicode|unicode data files and software|exhibit 1 unicode inc license agreement data files and software
2|curl|copyright and permission notice|copyright and permission notice copyright c (?:[^ ]+ ){1,12}daniel stenberg
2|postgresql|in no event shall the university of california be liable|in no event shall the university of california be liable to any party
2|ncsa|deal with the software without restriction|to deal with the software without restriction
2|afl-3.0|licensed under the academic free license|licensed under the academic free license version 3 0
2|osl-3.0|licensed under the open software license|licensed under the open software license version 3 0
2|eupl|licensed under the eupl|licensed under the eupl(?: v(?:ersion)? ?1 [012])?(?: or later)?
2|sspl-1|server side public license|released under the server side public license
2|commons-clause|commons clause|commons clause license condition v1 0
2|busl-1.1|business source license|use of this software is governed by the business source license
2|elastic-2.0|hosted or managed service|you may not provide the software to third parties as a hosted or managed service
2|tapr-ohl|tapr open hardware|tapr open hardware license(?: version)?(?: 1 0)?
2|cern-ohl|cern open hardware|cern open hardware licen[cs]e(?: version 2)?(?: (?:strongly|weakly) reciprocal| permissive)?
1|apache-2.0|www apache org|(?:https? )?www apache org licenses license 2 0(?: html| txt)?
1|apache-1.1|www apache org|(?:https? )?www apache org licenses license 1 1
1|mit|opensource org|(?:https? )?(?:www )?opensource org licenses mit(?: license)?(?: php)?
1|bsd-3-clause|opensource org|(?:https? )?(?:www )?opensource org licenses bsd 3 clause
1|bsd-2-clause|opensource org|(?:https? )?(?:www )?opensource org licenses bsd 2 clause
1|isc|opensource org|(?:https? )?(?:www )?opensource org licenses isc
1|artistic-2.0|opensource org|(?:https? )?(?:www )?opensource org licenses artistic license 2 0
1|gpl-2|www gnu org|(?:https? )?www gnu org licenses old licenses gpl 2 0
1|gpl-3|www gnu org|(?:https? )?www gnu org licenses gpl 3 0
1|lgpl-2.1|www gnu org|(?:https? )?www gnu org licenses old licenses lgpl 2 1
1|lgpl-3|www gnu org|(?:https? )?www gnu org licenses lgpl 3 0
1|agpl-3|www gnu org|(?:https? )?www gnu org licenses agpl 3 0
2|gfdl|www gnu org|(?:https? )?www gnu org (?:copyleft|licenses) fdl
3|gpl|www gnu org|(?:https? )?www gnu org (?:copyleft|licenses)
1|mpl-2.0|mozilla org mpl|(?:https? )?(?:www )?mozilla org mpl 2 0
2|mpl|mozilla org mpl|(?:https? )?(?:www )?mozilla org mpl
1|epl-2.0|www eclipse org legal|(?:https? )?www eclipse org legal epl 2 0
1|epl-1.0|www eclipse org legal|(?:https? )?www eclipse org legal epl v10
1|bsl-1.0|www boost org|(?:https? )?www boost org license 1 0 txt
1|ofl|scripts sil org ofl|(?:https? )?scripts sil org ofl
1|unlicense|unlicense org|(?:https? )?unlicense org
1|wtfpl|wtfpl net|(?:https? )?(?:www )?wtfpl net
1|odbl-1.0|opendatacommons org|(?:https? )?(?:www )?opendatacommons org licenses odbl
1|odc-by-1.0|opendatacommons org|(?:https? )?(?:www )?opendatacommons org licenses by
1|cc0-1.0|creativecommons org|(?:https? )?creativecommons org publicdomain zero 1 0
2|public-domain|creativecommons org|(?:https? )?creativecommons org (?:publicdomain|licenses publicdomain)(?: mark 1 0)?
3|cc|creativecommons org|(?:https? )?creativecommons org
2|cc0-1.0|cc0|cc0(?: 1 0)?(?: universal)?(?: public domain dedication)?
3|cc|creative commons|creative commons(?: public)? licen[cs]e
1|bsd-0-clause|bsd|(?:bsd 0 clause|0 clause bsd|zero clause bsd)(?: licen[cs]e)?
1|bsd-1-clause|bsd|(?:bsd 1 clause|1 clause bsd)(?: licen[cs]e)?
1|bsd-2-clause|bsd|(?:bsd 2 clause|2 clause bsd|two clause bsd)(?: licen[cs]e)?
1|bsd-3-clause|bsd|(?:bsd 3 clause|3 clause bsd|three clause bsd)(?: licen[cs]e)?
1|bsd-4-clause|bsd|(?:bsd 4 clause|4 clause bsd|four clause bsd)(?: licen[cs]e)?
2|bsd-2-clause|bsd|(?:simplified|free) bsd licen[cs]e
2|bsd-3-clause|bsd|(?:new|modified|revised) bsd licen[cs]e
2|bsd-4-clause|bsd|(?:original|old) bsd licen[cs]e
5|bsd|bsd|bsd (?:style )?licen[cs]e
4|mit|under the mit|(?:released|licensed|distributed|available) under the mit(?! (?:licen|v|\\d))
4|apache|under the apache|(?:released|licensed|distributed|available) under the apache(?! (?:licen|v|\\d))
4|bsd|under the bsd|(?:released|licensed|distributed|available) under the bsd(?! (?:licen|v|\\d))
4|gpl|under the gpl|(?:released|licensed|distributed|available) under the gpl(?! (?:licen|v|\\d))
4|lgpl|under the lgpl|(?:released|licensed|distributed|available) under the lgpl(?! (?:licen|v|\\d))
4|mit|mit style|mit style licen[cs]e
4|proprietary|confidential|(?:proprietary and confidential|confidential and proprietary)
4|proprietary|unauthorized copying|unauthorized copying of this file via any medium is strictly prohibited
4|proprietary|all rights reserved|all rights reserved
4|public-domain|public domain|(?:dedicated to|released into|placed in|placed into|in) the public domain
3|gpl|general public license|(?:gnu )?general public licen[cs]e
3|agpl|affero general public license|(?:gnu )?affero general public licen[cs]e
3|lgpl|lesser general public license|(?:gnu )?lesser general public licen[cs]e
3|lgpl|library general public license|(?:gnu )?library general public licen[cs]e
3|spdx|spdx license identifier|spdx license identifier [0-9a-z]+(?: (?:\\d+|by|nc|nd|sa|or|and|with|later|only|clause|exception)){0,12}
""".strip().split("\n")

CC_WORDS = {"by": "attribution", "nc": "non ?commercial", "nd": "no ?deriv(?:ative)?s?(?: works)?", "sa": "share ?alike"}
CC_TERMS = ["by nc nd", "by nc sa", "by nc", "by nd", "by sa", "by"]
CC_VERSIONS = ["1 0", "2 0", "2 5", "3 0", "4 0"]

# Identifiers of the tag ``SPDX-License-Identifier`` that get a label of their own.
SPDX = """
0bsd afl-3.0 agpl-3.0 apache-2.0 artistic-2.0 bsd-2-clause bsd-3-clause bsl-1.0 cc-by-4.0 cc-by-sa-4.0 cc0-1.0 cddl-1.0 cecill-2.1 ecl-2.0 epl-1.0 epl-2.0
eupl-1.2 gfdl-1.3 gpl-2.0 gpl-3.0 isc lgpl-2.1 lgpl-3.0 lppl-1.3c mit mit-0 mpl-2.0 ms-pl ncsa odbl-1.0 ofl-1.1 osl-3.0 postgresql python-2.0 unlicense upl-1.0 vim wtfpl x11 zlib
""".split()


def rules() -> list[tuple[str, str, int, str]]:
    out: list[tuple[str, str, int, str]] = []
    add = lambda keyword, pattern, priority, label: out.append((keyword, rf"(?<![^ ])(?:{pattern})(?![^ ])", priority, label))
    later = r"(?: of the license)? (?:or (?:at your option )?any later version|or later|and later)"
    for line in NAMED:
        name, label, versions = line.split("|")
        end = "" if name.endswith("agreement") or "license" in name else " licen[cs]e"
        stem = name if not end else f"{name} licen"
        add(stem, f"{name}{end}", 5, label)
        for v in versions.split():
            number = v.removesuffix(".0").replace(".", " ") + ("(?: 0)?" if v.endswith(".0") or "." not in v else "")
            full = rf"{name}{end}(?: as published by the free software foundation)?(?: either)? (?:version |v ?)?{number}"
            if label in ("agpl", "lgpl", "gpl", "gfdl"):
                add(stem, full + later, 1, f"{label}-{v}-or-later")
            add(stem, f"{full}(?: only)?", 2, f"{label}-{v}")
    for line in SHORT:
        keyword, label, pattern = line.split("|")
        short, keyword = keyword, f" {keyword}"
        if short in ("agpl", "lgpl", "gpl", "gfdl"):
            add(keyword, rf"{pattern}(?: or later| or any later version)", 1, f"{label}-or-later")
        add(keyword, rf"{pattern}(?: only)?", 3, label)
    for terms in CC_TERMS:
        label, words = f"cc-{terms.replace(' ', '-')}", " ".join(CC_WORDS[t] for t in terms.split())
        for v in CC_VERSIONS:
            add(" cc by", rf"cc {terms} {v}(?: international| unported)?", 1, f"{label}-{v.replace(' ', '.')}")
            add("creative commons", rf"creative commons {words} (?:license )?(?:version )?{v}(?: international| unported)?(?: licen[cs]e)?", 1, f"{label}-{v.replace(' ', '.')}")
        add("creativecommons org", rf"(?:https? )?creativecommons org licenses {terms} \d \d", 1, label)
        add("creative commons", rf"creative commons {words}", 2, label)
        add(" cc by", rf"cc {terms}", 4, label)
    for name in SPDX:
        words = name.replace("-", " ").replace(".", " ")
        add("spdx license identifier", rf"spdx license identifier {words}(?: only| or later)?", 2, name)
    for line in SIGNATURES:
        priority, label, keyword, pattern = line.split("|", 3)
        add(keyword, pattern, int(priority), label)
    return out


RULES = rules()
