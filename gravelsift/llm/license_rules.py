"""Hand-written license signatures: notices, identifiers, short names, headers and exceptions.

A line is: label | keyword | regular expression over lower-case words joined by single spaces. The keyword is a word of
every text that the rule matches. Rules stand in order: of equal detections the first one's stays.
"""

from __future__ import annotations

#: Texts of licenses and the sentences by which they are granted. A whole notice tells more than a name.
NOTICES = """
mit | hereby | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files(?: the software)? to deal in the software without restriction
mit | hereby | permission is hereby granted free of charge to any person obtaining a copy of this software
mit | permission | the above copyright notice and this permission notice(?: including the next paragraph)? shall be included in all copies or substantial portions of the software
mit | noninfringement | the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement
x11 | advertising | except as contained in this notice the names? of .{1,80}? shall not be used in advertising or otherwise to promote the sale
mit-0 | hereby | permission is hereby granted free of charge .{1,200}? to permit persons to whom the software is furnished to do so the software is provided as is
isc | fee | permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice
0bsd | fee | permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted the software is provided as is
hpnd | fee | permission to use copy modify and distribute this software and its documentation for any purpose(?: and)? without fee is hereby granted
bsd | redistribution | redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
bsd | redistributions | redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
bsd | redistributions | redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer
bsd-3-clause | endorse | neither the names? of .{1,120}? nor the names of (?:its|their) contributors may be used to endorse or promote products derived from this software
bsd-4-clause | advertising | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd | consequential | in no event shall the .{1,80}? be liable for any direct indirect incidental special exemplary or consequential damages
bsd-3-clause-clear | patent | no express or implied licenses to any party s patent rights are granted by this license
apache-2.0 | apache | licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license
apache-2.0 | apache | you may obtain a copy of the license at https? (?:www )?apache org licenses license 2 0
apache-2.0 | distributed | unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
apache-1.1 | apache | the end user documentation included with the redistribution if any must include the following acknowledge?ment this product includes software developed by the apache software foundation
apache | asf | licensed to the apache software foundation asf under one or more contributor license agreements
gpl | redistribute | this program is free software you can redistribute it and or modify it under the terms of the gnu general public license
gpl-3 | redistribute | you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3
gpl-2 | redistribute | you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2
lgpl | redistribute | you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license
lgpl-2.1 | lesser | terms of the gnu lesser general public license as published by the free software foundation either version 2 1
agpl-3 | redistribute | you can redistribute it and or modify it under the terms of the gnu affero general public license
gpl | distributed | distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose
gpl | received | you should have received a copy of the gnu general public license along with
lgpl | received | you should have received a copy of the gnu (?:lesser|library) general public license along with
agpl | received | you should have received a copy of the gnu affero general public license along with
gpl | freedom | the licenses for most software are designed to take away your freedom to share and change it
gpl | verbatim | everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed
gfdl | permission | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
gfdl | invariant | with no invariant sections no front cover texts and no back cover texts
mpl-2.0 | mozilla | this source code form is subject to the terms of the mozilla public license v 2 0
mpl-2.0 | mpl | if a copy of the mpl was not distributed with this file you can obtain one at
mpl-1.1 | mozilla | the contents of this file are subject to the mozilla public license version 1 1
epl | eclipse | this program and the accompanying materials are made available under the terms of the eclipse public license
cddl | distribution | the contents of this file are subject to the terms of the common development and distribution license
cpl | common | this program and the accompanying materials are made available under the terms of the common public license
epl | agreement | the accompanying program is provided under the terms of this eclipse public license agreement any use reproduction or distribution of the program constitutes recipient s acceptance
boost-1.0 | boost | boost software license version 1 0 august 17th 2003
boost-1.0 | organization | permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license
zlib | origin | the origin of this software must not be misrepresented you must not claim that you wrote the original software
zlib | altered | altered source versions must be plainly marked as such and must not be misrepresented as being the original software
unlicense | unencumbered | this is free and unencumbered software released into the public domain
unlicense | unencumbered | free and unencumbered software released into the public domain
wtfpl | fuck | do what the fuck you want to public license
wtfpl | wtfpl | (?:the )?wtfpl
beerware | beerware | the beerware license
beerware | beer | if we meet some day and you think this stuff is worth it you can buy me a beer
postgresql | fee | permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
ncsa | deal | to deal with the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense
artistic-2.0 | artistic | everyone is permitted to copy and distribute verbatim copies of this license document .{1,60}? artistic license 2 0
perl | perl | (?:under|on) the same terms as perl(?: 5| itself)?
ruby | ruby | (?:under|on) the same terms as ruby
python-2.0 | psf | psf license agreement for python
openssl | openssl | this product includes software developed by the openssl project for use in the openssl toolkit
php-3.01 | php | this source file is subject to version 3 01 of the php license
ofl-1.1 | font | this font software is licensed under the sil open font license version 1 1
ofl-1.1 | reserved | with reserved font names?
cc-by-4.0 | creative | licensed under a creative commons attribution 4 0 international license
cc-by-3.0 | creative | licensed under a creative commons attribution 3 0 unported license
cc-by-sa-4.0 | creative | licensed under a creative commons attribution share ?alike 4 0 international license
cc-by-sa-3.0 | creative | licensed under a creative commons attribution share ?alike 3 0 unported license
cc-by-nc-4.0 | creative | licensed under a creative commons attribution non ?commercial 4 0 international license
cc-by-nd-4.0 | creative | licensed under a creative commons attribution no ?deriv(?:ative)?s 4 0 international license
cc-by-nc-sa-4.0 | creative | licensed under a creative commons attribution non ?commercial share ?alike 4 0 international license
cc-by-nc-nd-4.0 | creative | licensed under a creative commons attribution non ?commercial no ?deriv(?:ative)?s 4 0 international license
cc0-1.0 | waived | has waived all copyright and related or neighboring rights to
cc0-1.0 | cc0 | to the extent possible under law .{1,80}? has (?:dedicated|waived) .{1,80}? cc0
cc | creativecommons | https? creativecommons org licenses [a-z ]{2,8} [0-9] [0-9]
cc0-1.0 | creativecommons | https? creativecommons org publicdomain zero 1 0
public-domain | domain | (?:dedicated|released|placed|put) (?:in|into|to) the public domain
public-domain | domain | (?:this (?:work|file|code|text) )?is (?:hereby )?(?:in|a work of) the public domain
public-domain | domain | public domain (?:dedication|mark|work)
proprietary | confidential | (?:proprietary and confidential|confidential and proprietary)
proprietary | prohibited | unauthori[sz]ed (?:copying|use|reproduction|distribution) .{0,80}?is (?:strictly )?prohibited
proprietary | permission | (?:may not|must not|cannot) be (?:copied|reproduced|used|distributed) .{0,60}?without (?:the )?(?:prior |express )?(?:written )?permission
proprietary | licensed | licensed not sold
all-rights-reserved | droits | tous droits r.serv.s
all-rights-reserved | vorbehalten | alle rechte vorbehalten
all-rights-reserved | derechos | todos los derechos reservados
copyright | copyright | copyright (?:c )?(?:by )?the .{1,40}? (?:authors|contributors|project)
ms-pl | microsoft | microsoft public license ms pl this license governs use of the accompanying software
ms-rl | microsoft | microsoft reciprocal license ms rl
eupl-1.2 | eupl | licensed under the eupl version 1 2
eupl-1.1 | eupl | licensed under the eupl version 1 1
cecill-2.1 | cecill | this software is governed by the cecill license under french law
cecill-b | cecill | this software is governed by the cecill b license under french law
cecill-c | cecill | this software is governed by the cecill c license under french law
sspl-1.0 | server | server side public license(?: version 1)?
busl-1.1 | business | business source license 1 1
elastic-2.0 | elastic | elastic license(?: version)? 2 0
commons-clause | commons | commons clause license condition(?: v1 0)?
polyform-nc-1.0 | polyform | polyform noncommercial license 1 0 0
blueoak-1.0 | blue | blue oak model license(?: version)? 1 0 0
upl-1.0 | universal | the universal permissive license upl version 1 0
mulan-psl-2.0 | mulan | mulan permissive software license v2
llama | llama | llama (?:2|3|3 1|3 2) community license(?: agreement)?
openrail | rail | (?:creativeml )?open rail m? ?licen[cs]e
odc-by-1.0 | commons | open data commons attribution license(?: v1 0)?
pddl-1.0 | dedication | (?:open data commons )?public domain dedication (?:and )?license
odbl-1.0 | database | open database license(?: odbl)?(?: v1 0)?
cdla-permissive | community | community data license agreement permissive
cdla-sharing | community | community data license agreement sharing
"""

#: Exceptions and options that change a license.
EXCEPTIONS = """
classpath-exception | classpath | (?:with (?:the )?)?classpath exception(?: 2 0)?
classpath-exception | independent | as a special exception the copyright holders of this library give you permission to link this library with independent modules
gcc-exception | gcc | gcc runtime library exception(?: version)?(?: 3 1| 2 0)?
autoconf-exception | autoconf | as a special exception to the gnu general public license if you distribute this file as part of a program that contains a configuration script generated by autoconf
bison-exception | bison | as a special exception you may create a larger work that contains part or all of the bison parser skeleton
font-exception | font | as a special exception if you create a document which uses this font
openssl-exception | openssl | as a special exception .{1,120}? permission to link (?:the code of )?.{1,80}? openssl
llvm-exception | llvm | (?:with )?llvm exceptions?
linux-syscall-note | syscall | (?:with )?linux syscall note
universal-foss-exception | foss | universal foss exception(?: version)? 1 0
no-copyleft-exception | copyleft | no copyleft exception
or-later | later | (?:either )?version [0-9](?: [0-9])? of the license or at your option any later version
dual-license | dual | (?:is )?dual licen[cs]ed
dual-license | licensed | licensed under either of
"""

#: Identifiers of licenses as they stand after "SPDX-License-Identifier:" and, as a rule, in package files.
IDENTIFIERS = """
0bsd 0BSD
afl-3.0 AFL-3.0
agpl-3 AGPL-3.0-only
agpl-3 AGPL-3.0-or-later
agpl-3 AGPL-3.0
apache-1.1 Apache-1.1
apache-2.0 Apache-2.0
artistic-1.0 Artistic-1.0
artistic-2.0 Artistic-2.0
blueoak-1.0 BlueOak-1.0.0
bsd-1-clause BSD-1-Clause
bsd-2-clause BSD-2-Clause
bsd-3-clause BSD-3-Clause
bsd-3-clause-clear BSD-3-Clause-Clear
bsd-4-clause BSD-4-Clause
bsd-2-clause-patent BSD-2-Clause-Patent
boost-1.0 BSL-1.0
busl-1.1 BUSL-1.1
cc-by-1.0 CC-BY-1.0
cc-by-2.0 CC-BY-2.0
cc-by-2.5 CC-BY-2.5
cc-by-3.0 CC-BY-3.0
cc-by-4.0 CC-BY-4.0
cc-by-sa-2.0 CC-BY-SA-2.0
cc-by-sa-3.0 CC-BY-SA-3.0
cc-by-sa-4.0 CC-BY-SA-4.0
cc-by-nc-3.0 CC-BY-NC-3.0
cc-by-nc-4.0 CC-BY-NC-4.0
cc-by-nd-4.0 CC-BY-ND-4.0
cc-by-nc-sa-4.0 CC-BY-NC-SA-4.0
cc-by-nc-nd-4.0 CC-BY-NC-ND-4.0
cc0-1.0 CC0-1.0
cddl-1.0 CDDL-1.0
cddl-1.1 CDDL-1.1
cecill-2.1 CECILL-2.1
cpl-1.0 CPL-1.0
ecl-2.0 ECL-2.0
epl-1.0 EPL-1.0
epl-2.0 EPL-2.0
eupl-1.1 EUPL-1.1
eupl-1.2 EUPL-1.2
gfdl-1.1 GFDL-1.1
gfdl-1.2 GFDL-1.2
gfdl-1.3 GFDL-1.3
gpl-1 GPL-1.0
gpl-2 GPL-2.0-only
gpl-2 GPL-2.0-or-later
gpl-2 GPL-2.0
gpl-3 GPL-3.0-only
gpl-3 GPL-3.0-or-later
gpl-3 GPL-3.0
hpnd HPND
isc ISC
lgpl-2 LGPL-2.0
lgpl-2.1 LGPL-2.1-only
lgpl-2.1 LGPL-2.1-or-later
lgpl-2.1 LGPL-2.1
lgpl-3 LGPL-3.0-only
lgpl-3 LGPL-3.0-or-later
lgpl-3 LGPL-3.0
mit MIT
mit-0 MIT-0
mpl-1.0 MPL-1.0
mpl-1.1 MPL-1.1
mpl-2.0 MPL-2.0
ms-pl MS-PL
ms-rl MS-RL
mulan-psl-2.0 MulanPSL-2.0
ncsa NCSA
odbl-1.0 ODbL-1.0
ofl-1.1 OFL-1.1
openssl OpenSSL
osl-3.0 OSL-3.0
pddl-1.0 PDDL-1.0
php-3.01 PHP-3.01
postgresql PostgreSQL
python-2.0 Python-2.0
python-2.0 PSF-2.0
ruby Ruby
sspl-1.0 SSPL-1.0
unlicense Unlicense
upl-1.0 UPL-1.0
vim Vim
wtfpl WTFPL
x11 X11
zlib Zlib
zpl-2.1 ZPL-2.1
"""

#: Short names with a version written onto them, each a word of its own.
SHORT_NAMES = """
gpl-1 gplv1
gpl-2 gplv2
gpl-3 gplv3
gpl-2 gpl2
gpl-3 gpl3
lgpl-2 lgplv2
lgpl-3 lgplv3
lgpl-2 lgpl2
lgpl-3 lgpl3
agpl-3 agplv3
agpl-3 agpl3
cc0 cc0
wtfpl wtfpl
"""
