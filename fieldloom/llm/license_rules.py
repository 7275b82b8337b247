"""Signature rules of license notices, written by hand: `label: regular expression`, by priority and in the order they are tried.

A rule is matched against lower-cased words with single spaces between them (`Apache-2.0` is `apache 2 0`), from word start
to word end; \\S+ is any word. Of the rules of one priority the first that matches at a place holds, so longer forms come first.
"""

from __future__ import annotations

# Priority 4: SPDX identifiers, grants and warranty clauses that only one license has.
EXACT = r"""
agpl-3.0: spdx licen[cs]e identifier agpl 3 0(?: only| or later)?
agpl-1.0: spdx licen[cs]e identifier agpl 1 0(?: only| or later)?
lgpl-3.0: spdx licen[cs]e identifier lgpl 3 0(?: only| or later)?
lgpl-2.1: spdx licen[cs]e identifier lgpl 2 1(?: only| or later)?
lgpl-2.0: spdx licen[cs]e identifier lgpl 2 0(?: only| or later)?
gpl-3.0: spdx licen[cs]e identifier gpl 3 0(?: only| or later)?
gpl-2.0: spdx licen[cs]e identifier gpl 2 0(?: only| or later)?
gpl-1.0: spdx licen[cs]e identifier gpl 1 0(?: only| or later)?
gfdl-1.3: spdx licen[cs]e identifier gfdl 1 3(?: only| or later)?
gfdl-1.2: spdx licen[cs]e identifier gfdl 1 2(?: only| or later)?
apache-2.0: spdx licen[cs]e identifier apache 2 0
apache-1.1: spdx licen[cs]e identifier apache 1 1
mit-0: spdx licen[cs]e identifier mit 0
mit: spdx licen[cs]e identifier mit
bsd-2-clause: spdx licen[cs]e identifier bsd 2 clause(?: patent)?
bsd-3-clause: spdx licen[cs]e identifier bsd 3 clause(?: clear)?
bsd-4-clause: spdx licen[cs]e identifier bsd 4 clause
0bsd: spdx licen[cs]e identifier 0bsd
isc: spdx licen[cs]e identifier isc
mpl-2.0: spdx licen[cs]e identifier mpl 2 0
mpl-1.1: spdx licen[cs]e identifier mpl 1 1
epl-2.0: spdx licen[cs]e identifier epl 2 0
epl-1.0: spdx licen[cs]e identifier epl 1 0
cddl-1.1: spdx licen[cs]e identifier cddl 1 1
cddl-1.0: spdx licen[cs]e identifier cddl 1 0
bsl-1.0: spdx licen[cs]e identifier bsl 1 0
busl-1.1: spdx licen[cs]e identifier busl 1 1
zlib: spdx licen[cs]e identifier zlib
artistic-2.0: spdx licen[cs]e identifier artistic 2 0
artistic-1.0: spdx licen[cs]e identifier artistic 1 0
ofl-1.1: spdx licen[cs]e identifier ofl 1 1
eupl-1.2: spdx licen[cs]e identifier eupl 1 2
eupl-1.1: spdx licen[cs]e identifier eupl 1 1
psf-2.0: spdx licen[cs]e identifier (?:psf|python) 2 0
ms-pl: spdx licen[cs]e identifier ms pl
ms-rl: spdx licen[cs]e identifier ms rl
odbl-1.0: spdx licen[cs]e identifier odbl 1 0
afl-3.0: spdx licen[cs]e identifier afl 3 0
osl-3.0: spdx licen[cs]e identifier osl 3 0
cecill-2.1: spdx licen[cs]e identifier cecill 2 1
wtfpl: spdx licen[cs]e identifier wtfpl
unlicense: spdx licen[cs]e identifier unlicense
cc0-1.0: spdx licen[cs]e identifier cc0 1 0
cc-by-nc-sa-4.0: spdx licen[cs]e identifier cc by nc sa 4 0
cc-by-nc-nd-4.0: spdx licen[cs]e identifier cc by nc nd 4 0
cc-by-nc-4.0: spdx licen[cs]e identifier cc by nc 4 0
cc-by-nd-4.0: spdx licen[cs]e identifier cc by nd 4 0
cc-by-sa-4.0: spdx licen[cs]e identifier cc by sa 4 0
cc-by-4.0: spdx licen[cs]e identifier cc by 4 0
cc-by-sa-3.0: spdx licen[cs]e identifier cc by sa 3 0
cc-by-3.0: spdx licen[cs]e identifier cc by 3 0
mit: permission is hereby granted free of charge to any person obtaining a copy of this software
mit: permission is hereby granted free of charge to any person obtaining a copy
mit: the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit: in no event shall the authors or copyright holders be liable for any claim damages or other liability
isc: permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc: permission to use copy modify and or distribute this software for any purpose
bsd: redistribution and use in source and binary forms with or without modification are permitted
bsd: redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
bsd: redistributions in binary form must reproduce the above copyright notice
bsd-3-clause: neither the name of(?: \S+){1,8} nor the names of its contributors may be used to endorse
bsd-4-clause: all advertising materials mentioning features or use of this software must display
apache-2.0: licensed under the apache licen[cs]e version 2 0 the licen[cs]e you may not use this file except in compliance with the licen[cs]e
apache-2.0: you may obtain a copy of the licen[cs]e at http www apache org licenses licen[cs]e 2 0
apache-2.0: grant of patent licen[cs]e subject to the terms and conditions of this licen[cs]e
gpl: you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e
lgpl: you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public licen[cs]e
agpl: you can redistribute it and or modify it under the terms of the gnu affero general public licen[cs]e
gpl: this program is distributed in the hope that it will be useful but without any warranty
gpl: you should have received a copy of the gnu general public licen[cs]e
lgpl: you should have received a copy of the gnu (?:lesser|library) general public licen[cs]e
agpl: you should have received a copy of the gnu affero general public licen[cs]e
gfdl: permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[cs]e
mpl-2.0: this source code form is subject to the terms of the mozilla public licen[cs]e v 2 0
mpl: the contents of this file are subject to the mozilla public licen[cs]e
epl-2.0: this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e 2 0
epl-1.0: this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e v1 0
cddl: the contents of this file are subject to the terms of the common development and distribution licen[cs]e
bsl-1.0: distributed under the boost software licen[cs]e version 1 0
zlib: this software is provided as is without any express or implied warranty in no event will the authors be held liable
zlib: altered source versions must be plainly marked as such
unlicense: this is free and unencumbered software released into the public domain
wtfpl: do what the fuck you want to public licen[cs]e
cc0-1.0: to the extent possible under law(?: \S+){1,8} has waived all copyright
ofl-1.1: this font software is licensed under the sil open font licen[cs]e version 1 1
artistic-2.0: this is free software you may redistribute it under the terms of the artistic licen[cs]e 2 0
psf-2.0: this licen[cs]e agreement is between the python software foundation
ms-pl: this licen[cs]e governs use of the accompanying software if you use the software you accept this licen[cs]e
proprietary: unauthorized copying of this file via any medium is strictly prohibited
"""

# Priority 3: notices that put something under a license, and forms that say which later versions count.
NOTICES = r"""
agpl-3.0: gnu affero general public licen[cs]e(?: as published by the free software foundation either)? version 3(?: 0)?(?: of the licen[cs]e)? or(?: at your option)? any later version
lgpl-3.0: gnu lesser general public licen[cs]e(?: as published by the free software foundation either)? version 3(?: 0)?(?: of the licen[cs]e)? or(?: at your option)? any later version
lgpl-2.1: gnu lesser general public licen[cs]e(?: as published by the free software foundation either)? version 2 1(?: of the licen[cs]e)? or(?: at your option)? any later version
gpl-3.0: gnu general public licen[cs]e(?: as published by the free software foundation either)? version 3(?: 0)?(?: of the licen[cs]e)? or(?: at your option)? any later version
gpl-2.0: gnu general public licen[cs]e(?: as published by the free software foundation either)? version 2(?: 0)?(?: of the licen[cs]e)? or(?: at your option)? any later version
agpl-3.0: agpl(?: v| version)? 3 0 (?:only|or later)
lgpl-3.0: lgpl(?: v| version)? 3 0 (?:only|or later)
lgpl-2.1: lgpl(?: v| version)? 2 1 (?:only|or later)
gpl-3.0: gpl(?: v| version)? 3 0 (?:only|or later)
gpl-2.0: gpl(?: v| version)? 2 0 (?:only|or later)
gpl-3.0: gplv3 (?:only|or later|or any later version)
gpl-2.0: gplv2 (?:only|or later|or any later version)
gpl: same terms as perl itself
agpl-3.0: (?:licensed|released|distributed|available|published)(?: \S+){0,2} under(?: the)?(?: terms of the)? (?:gnu )?(?:agpl|affero general public licen[cs]e)(?: v| version)? (?:v3|3)(?: 0)?
agpl: (?:licensed|released|distributed|available|published)(?: \S+){0,2} under(?: the)?(?: terms of the)? (?:gnu )?(?:agpl|affero general public licen[cs]e)
lgpl-3.0: (?:licensed|released|distributed|available|published)(?: \S+){0,2} under(?: the)?(?: terms of the)? (?:gnu )?(?:lgpl|lesser general public licen[cs]e)(?: v| version)? (?:v3|3)(?: 0)?
lgpl-2.1: (?:licensed|released|distributed|available|published)(?: \S+){0,2} under(?: the)?(?: terms of the)? (?:gnu )?(?:lgpl|lesser general public licen[cs]e)(?: v| version)? (?:v2|2) 1
lgpl: (?:licensed|released|distributed|available|published)(?: \S+){0,2} under(?: the)?(?: terms of the)? (?:gnu )?(?:lgpl|lesser general public licen[cs]e)
gpl-3.0: (?:licensed|released|distributed|available|published)(?: \S+){0,2} under(?: the)?(?: terms of the)? (?:gnu )?(?:gpl|general public licen[cs]e)(?: v| version)? (?:v3|3)(?: 0)?
gpl-2.0: (?:licensed|released|distributed|available|published)(?: \S+){0,2} under(?: the)?(?: terms of the)? (?:gnu )?(?:gpl|general public licen[cs]e)(?: v| version)? (?:v2|2)(?: 0)?
gpl: (?:licensed|released|distributed|available|published)(?: \S+){0,2} under(?: the)?(?: terms of the)? (?:gnu )?(?:gpl|general public licen[cs]e)
gfdl: (?:licensed|released|distributed|available|published)(?: \S+){0,2} under(?: the)?(?: terms of the)? (?:gnu )?(?:gfdl|free documentation licen[cs]e)
apache-2.0: (?:licensed|released|distributed|available|published)(?: \S+){0,2} under(?: the)?(?: terms of the)? apache(?: software)?(?: licen[cs]e)?(?: v| version)? (?:v2|2)(?: 0)?
apache: (?:licensed|released|distributed|available|published)(?: \S+){0,2} under(?: the)?(?: terms of the)? apache(?: software)? licen[cs]e
mit: (?:licensed|released|distributed|available|published)(?: \S+){0,2} under(?: the| an)?(?: terms of the)? (?:mit|expat|x11)(?: x11)?(?: style)?(?: licen[cs]e)?
bsd-3-clause: (?:licensed|released|distributed|available|published)(?: \S+){0,2} under(?: the| a)?(?: terms of the)? (?:new bsd|modified bsd|revised bsd|(?:3|three) clause bsd|bsd (?:3|three) clause)(?: licen[cs]e)?
bsd-2-clause: (?:licensed|released|distributed|available|published)(?: \S+){0,2} under(?: the| a)?(?: terms of the)? (?:simplified bsd|freebsd|(?:2|two) clause bsd|bsd (?:2|two) clause)(?: licen[cs]e)?
bsd: (?:licensed|released|distributed|available|published)(?: \S+){0,2} under(?: the| a)?(?: terms of the)? bsd(?: style)?(?: licen[cs]e)?
isc: (?:licensed|released|distributed|available|published)(?: \S+){0,2} under(?: the)?(?: terms of the)? isc(?: licen[cs]e)?
mpl-2.0: (?:licensed|released|distributed|available|published)(?: \S+){0,2} under(?: the)?(?: terms of the)? (?:mpl|mozilla public licen[cs]e)(?: v| version)? (?:v2|2)(?: 0)?
mpl: (?:licensed|released|distributed|available|published)(?: \S+){0,2} under(?: the)?(?: terms of the)? (?:mpl|mozilla public licen[cs]e)
epl: (?:licensed|released|distributed|available|published)(?: \S+){0,2} under(?: the)?(?: terms of the)? eclipse public licen[cs]e
eupl: (?:licensed|released|distributed|available|published)(?: \S+){0,2} under(?: the)?(?: terms of the)? (?:eupl|european union public licen[cs]e)
artistic: (?:licensed|released|distributed|available|published)(?: \S+){0,2} under(?: the)?(?: terms of the)? artistic licen[cs]e
ofl: (?:licensed|released|distributed|available|published)(?: \S+){0,2} under(?: the)?(?: terms of the)? (?:sil )?open font licen[cs]e
odbl: (?:licensed|released|distributed|available|published)(?: \S+){0,2} under(?: the)?(?: terms of the)? (?:odbl|open database licen[cs]e)
cc0: (?:licensed|released|distributed|available|published)(?: \S+){0,2} under(?: the)?(?: terms of the)? (?:cc0|creative commons zero)
cc-by-nc-sa: (?:licensed|released|distributed|available|published)(?: \S+){0,2} under(?: the| a)? (?:cc by nc sa|creative commons attribution (?:noncommercial|non commercial) (?:sharealike|share alike))
cc-by-nc-nd: (?:licensed|released|distributed|available|published)(?: \S+){0,2} under(?: the| a)? (?:cc by nc nd|creative commons attribution (?:noncommercial|non commercial) (?:noderivs|noderivatives|no derivatives))
cc-by-nc: (?:licensed|released|distributed|available|published)(?: \S+){0,2} under(?: the| a)? (?:cc by nc|creative commons attribution (?:noncommercial|non commercial))
cc-by-sa: (?:licensed|released|distributed|available|published)(?: \S+){0,2} under(?: the| a)? (?:cc by sa|creative commons attribution (?:sharealike|share alike))
cc-by-nd: (?:licensed|released|distributed|available|published)(?: \S+){0,2} under(?: the| a)? (?:cc by nd|creative commons attribution (?:noderivs|noderivatives|no derivatives))
cc-by: (?:licensed|released|distributed|available|published)(?: \S+){0,2} under(?: the| a)? (?:cc by|creative commons attribution)
creative-commons: (?:licensed|released|distributed|available|published)(?: \S+){0,2} under(?: the| a)? creative commons licen[cs]e
public-domain: (?:released|placed|dedicated|put) (?:in|into|to) the public domain
public-domain: public domain dedication
proprietary: proprietary and confidential
proprietary: may not be reproduced(?: \S+){0,6} without(?: \S+){0,3} written permission
proprietary: use reproduction or disclosure(?: \S+){0,4} is prohibited
busl-1.1: business source licen[cs]e 1 1
sspl-1.0: server side public licen[cs]e(?: v| version)? (?:v1|1)
"""

# Priority 2: names, with their versions and as one word.
NAMES = r"""
agpl-3.0: (?:gnu )?affero general public licen[cs]e(?: v| version)? (?:v3|3)(?: 0)?
agpl-1.0: (?:gnu )?affero general public licen[cs]e(?: v| version)? (?:v1|1)(?: 0)?
agpl: (?:gnu )?affero general public licen[cs]e
agpl-3.0: (?:gnu )?agpl(?: v| version)? (?:v3|3)(?: 0)?
agpl-3.0: agplv3
agpl: (?:gnu )?agpl
lgpl-3.0: (?:gnu )?lesser general public licen[cs]e(?: v| version)? (?:v3|3)(?: 0)?
lgpl-2.1: (?:gnu )?lesser general public licen[cs]e(?: v| version)? (?:v2|2) 1
lgpl-2.0: (?:gnu )?(?:lesser|library) general public licen[cs]e(?: v| version)? (?:v2|2)(?: 0)?
lgpl: (?:gnu )?(?:lesser|library) general public licen[cs]e
lgpl-3.0: (?:gnu )?lgpl(?: v| version)? (?:v3|3)(?: 0)?
lgpl-2.1: (?:gnu )?lgpl(?: v| version)? (?:v2|2) 1
lgpl-2.0: (?:gnu )?lgpl(?: v| version)? (?:v2|2)(?: 0)?
lgpl-3.0: lgplv3
lgpl-2.1: lgplv2 1
lgpl-2.0: lgplv2
lgpl: (?:gnu )?lgpl
gpl-3.0: (?:gnu )?general public licen[cs]e(?: v| version)? (?:v3|3)(?: 0)?
gpl-2.0: (?:gnu )?general public licen[cs]e(?: v| version)? (?:v2|2)(?: 0)?
gpl-1.0: (?:gnu )?general public licen[cs]e(?: v| version)? (?:v1|1)(?: 0)?
gpl: gnu general public licen[cs]e
gpl-3.0: (?:gnu )?gpl(?: v| version)? (?:v3|3)(?: 0)?
gpl-2.0: (?:gnu )?gpl(?: v| version)? (?:v2|2)(?: 0)?
gpl-1.0: (?:gnu )?gpl(?: v| version)? (?:v1|1)(?: 0)?
gpl-3.0: gplv3
gpl-2.0: gplv2
gpl: (?:gnu )?gpl
gfdl-1.3: (?:gnu )?free documentation licen[cs]e(?: v| version)? (?:v1|1) 3
gfdl-1.2: (?:gnu )?free documentation licen[cs]e(?: v| version)? (?:v1|1) 2
gfdl: (?:gnu )?free documentation licen[cs]e
gfdl: gfdl
apache-2.0: apache(?: software)? licen[cs]e(?: v| version)? (?:v2|2)(?: 0)?
apache-1.1: apache(?: software)? licen[cs]e(?: v| version)? (?:v1|1) 1
apache-1.0: apache(?: software)? licen[cs]e(?: v| version)? (?:v1|1)(?: 0)?
apache: apache(?: software)? licen[cs]e
apache-2.0: apache 2 0
mit: mit x11 licen[cs]e
mit: (?:mit|expat|x11)(?: style)? licen[cs]e
mit-0: mit no attribution(?: licen[cs]e)?
bsd-3-clause: (?:new|modified|revised) bsd licen[cs]e
bsd-2-clause: (?:simplified bsd|freebsd) licen[cs]e
bsd-3-clause: (?:3|three) clause bsd(?: licen[cs]e)?
bsd-2-clause: (?:2|two) clause bsd(?: licen[cs]e)?
bsd-4-clause: (?:4|four) clause bsd(?: licen[cs]e)?
bsd-3-clause: bsd (?:3|three) clause(?: licen[cs]e)?
bsd-2-clause: bsd (?:2|two) clause(?: licen[cs]e)?
bsd-4-clause: bsd (?:4|four) clause(?: licen[cs]e)?
bsd-4-clause: original bsd licen[cs]e
0bsd: (?:zero clause bsd|0bsd|bsd zero clause)(?: licen[cs]e)?
bsd: bsd(?: style)? licen[cs]e
isc: isc licen[cs]e
mpl-2.0: mozilla public licen[cs]e(?: v| version)? (?:v2|2)(?: 0)?
mpl-1.1: mozilla public licen[cs]e(?: v| version)? (?:v1|1) 1
mpl: mozilla public licen[cs]e
mpl-2.0: mpl(?: v| version)? (?:v2|2)(?: 0)?
mpl-1.1: mpl(?: v| version)? (?:v1|1) 1
mpl: mpl licen[cs]e
epl-2.0: eclipse public licen[cs]e(?: v| version)? (?:v2|2)(?: 0)?
epl-1.0: eclipse public licen[cs]e(?: v| version)? (?:v1|1)(?: 0)?
epl: eclipse public licen[cs]e
cddl-1.1: common development and distribution licen[cs]e(?: v| version)? (?:v1|1) 1
cddl-1.0: common development and distribution licen[cs]e(?: v| version)? (?:v1|1)(?: 0)?
cddl: common development and distribution licen[cs]e
cpl-1.0: common public licen[cs]e(?: v| version)? (?:v1|1)(?: 0)?
bsl-1.0: boost software licen[cs]e
artistic-2.0: artistic licen[cs]e(?: v| version)? (?:v2|2)(?: 0)?
artistic-1.0: artistic licen[cs]e(?: v| version)? (?:v1|1)(?: 0)?
artistic: artistic licen[cs]e
zlib: zlib(?: libpng)? licen[cs]e
libpng: libpng licen[cs]e
unlicense: the unlicense
unlicense: unlicense
afl-3.0: academic free licen[cs]e(?: v| version)? (?:v3|3)(?: 0)?
afl: academic free licen[cs]e
osl-3.0: open software licen[cs]e(?: v| version)? (?:v3|3)(?: 0)?
osl: open software licen[cs]e
eupl-1.2: european union public licen[cs]e(?: v| version)? (?:v1|1) 2
eupl-1.1: european union public licen[cs]e(?: v| version)? (?:v1|1) 1
eupl: european union public licen[cs]e
psf-2.0: python software foundation licen[cs]e
php-3.01: php licen[cs]e(?: v| version)? 3 01
ruby: ruby licen[cs]e
openssl: openssl licen[cs]e
postgresql: postgresql licen[cs]e
ncsa: (?:university of illinois )?ncsa(?: open source)? licen[cs]e
cecill-2.1: cecill(?: free software)? licen[cs]e(?: agreement)?
ofl-1.1: (?:sil )?open font licen[cs]e(?: v| version)? (?:v1|1) 1
ofl: (?:sil )?open font licen[cs]e
ms-pl: microsoft public licen[cs]e
ms-rl: microsoft reciprocal licen[cs]e
odbl-1.0: open database licen[cs]e
odc-by: open data commons attribution licen[cs]e
wtfpl: wtfpl
sspl-1.0: server side public licen[cs]e
cc0-1.0: cc0(?: 1 0)?(?: universal)?
cc0-1.0: creative commons zero(?: 1 0)?
cc-by-nc-sa-4.0: cc by nc sa 4 0
cc-by-nc-sa-3.0: cc by nc sa 3 0
cc-by-nc-sa: cc by nc sa
cc-by-nc-nd-4.0: cc by nc nd 4 0
cc-by-nc-nd-3.0: cc by nc nd 3 0
cc-by-nc-nd: cc by nc nd
cc-by-nc-4.0: cc by nc 4 0
cc-by-nc-3.0: cc by nc 3 0
cc-by-nc: cc by nc
cc-by-sa-4.0: cc by sa 4 0
cc-by-sa-3.0: cc by sa 3 0
cc-by-sa-2.5: cc by sa 2 5
cc-by-sa: cc by sa
cc-by-nd-4.0: cc by nd 4 0
cc-by-nd: cc by nd
cc-by-4.0: cc by 4 0
cc-by-3.0: cc by 3 0
cc-by-2.0: cc by 2 0
cc-by: cc by
cc-by-nc-sa: creative commons attribution (?:noncommercial|non commercial) (?:sharealike|share alike)
cc-by-nc-nd: creative commons attribution (?:noncommercial|non commercial) (?:noderivs|noderivatives|no derivatives)
cc-by-nc: creative commons attribution (?:noncommercial|non commercial)
cc-by-sa: creative commons attribution (?:sharealike|share alike)
cc-by-nd: creative commons attribution (?:noderivs|noderivatives|no derivatives)
cc-by: creative commons attribution
creative-commons: creative commons licen[cs]e
"""

# Priority 1: mentions that say little by themselves.
MENTIONS = r"""
proprietary: all rights reserved
public-domain: public domain
copyleft: copyleft
unknown-license: see the licen[cs]e file
unknown-license: this software is licensed under
unknown-license: licen[cs]e agreement
"""

#: Parts of single words, one of which is in every text that a rule matches, besides the short forms of Creative Commons.
SIGNS = ["licen", "gpl", "mpl", "creative", "wtfpl", "reserved", "domain", "permission", "redistribut", "copyleft", "proprietary", "warranty", "copyright", "apache", "bsd", "gfdl", "liab", "perl", "advertising", "altered", "unauthorized", "disclosure", "attribution", "endorse"]
#: No rule matches more words than this.
MOST_WORDS = 32


def rules() -> dict[int, list[tuple[str, str]]]:
    """(label, regular expression) of each priority, in order."""
    texts = {4: EXACT, 3: NOTICES, 2: NAMES, 1: MENTIONS}
    return {priority: [tuple(line.split(": ", 1)) for line in text.strip().split("\n")] for priority, text in texts.items()}
