"""Licence signature rules.

A line is ``label | keyword | pattern``.  Patterns are regular expressions over
lower-case words with one blank between them; the keyword is text that every
match contains.  Blocks are ordered by priority: the first outranks the later.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Rule:
    number: int
    priority: int
    confidence: float
    label: str
    keyword: str
    pattern: str


_V = r"(?:version |v |ver )?"

#: Titles and notices that name a licence with its version.
_TITLES = rf"""
gpl-1.0 | general public license | gnu general public license {_V}v?1(?: 0)?
gpl-2.0 | general public license | gnu general public license {_V}v?2(?: 0)?
gpl-3.0 | general public license | gnu general public license {_V}v?3(?: 0)?
gpl-2.0-or-later | general public license | gnu general public license {_V}v?2(?: 0)? or (?:at your option )?any later version
gpl-3.0-or-later | general public license | gnu general public license {_V}v?3(?: 0)? or (?:at your option )?any later version
lgpl-2.0 | general public license | gnu (?:lesser|library) general public license {_V}v?2(?: 0)?
lgpl-2.1 | general public license | gnu lesser general public license {_V}v?2 1
lgpl-3.0 | general public license | gnu lesser general public license {_V}v?3(?: 0)?
agpl-3.0 | general public license | gnu affero general public license {_V}v?3(?: 0)?
agpl-1.0 | general public license | affero general public license {_V}v?1(?: 0)?
gfdl-1.1 | free documentation license | gnu free documentation license {_V}1 1
gfdl-1.2 | free documentation license | gnu free documentation license {_V}1 2
gfdl-1.3 | free documentation license | gnu free documentation license {_V}1 3
apache-1.0 | apache license | apache license {_V}1 0
apache-1.1 | apache | apache (?:software )?license {_V}1 1
apache-2.0 | apache license | apache license {_V}2(?: 0)?
mpl-1.0 | mozilla public license | mozilla public license {_V}1 0
mpl-1.1 | mozilla public license | mozilla public license {_V}1 1
mpl-2.0 | mozilla public license | mozilla public license {_V}2(?: 0)?
epl-1.0 | eclipse public license | eclipse public license {_V}1 0
epl-2.0 | eclipse public license | eclipse public license {_V}2(?: 0)?
edl-1.0 | eclipse distribution license | eclipse distribution license {_V}1 0
cddl-1.0 | development and distribution license | common development and distribution license (?:cddl )?{_V}1 0
cddl-1.1 | development and distribution license | common development and distribution license (?:cddl )?{_V}1 1
eupl-1.0 | european union public licen | european union public licen[cs]e {_V}1 0
eupl-1.1 | european union public licen | european union public licen[cs]e {_V}1 1
eupl-1.2 | european union public licen | european union public licen[cs]e {_V}1 2
bsl-1.0 | boost software license | boost software license {_V}1 0
busl-1.1 | business source license | business source license {_V}1 1
artistic-1.0 | artistic license | artistic license {_V}1 0
artistic-2.0 | artistic license | artistic license {_V}2 0
afl-2.1 | academic free license | academic free license {_V}2 1
afl-3.0 | academic free license | academic free license {_V}3 0
osl-1.0 | open software license | open software license {_V}1 0
osl-2.1 | open software license | open software license {_V}2 1
osl-3.0 | open software license | open software license {_V}3 0
ecl-1.0 | educational community license | educational community license {_V}1 0
ecl-2.0 | educational community license | educational community license {_V}2 0
cecill-1.0 | cecill | cecill (?:free software )?(?:license )?(?:agreement )?{_V}v?1 0
cecill-2.0 | cecill | cecill (?:free software )?(?:license )?(?:agreement )?{_V}v?2 0
cecill-2.1 | cecill | cecill (?:free software )?(?:license )?(?:agreement )?{_V}v?2 1
cpl-1.0 | common public license | common public license {_V}1 0
cpal-1.0 | public attribution license | common public attribution license {_V}1 0
ipl-1.0 | ibm public license | ibm public license {_V}1 0
lpl-1.02 | lucent public license | lucent public license {_V}1 02
lppl-1.0 | project public license | latex project public license {_V}1 0
lppl-1.3c | project public license | latex project public license {_V}1 3c?
apsl-1.0 | apple public source license | apple public source license {_V}1 0
apsl-2.0 | apple public source license | apple public source license {_V}2 0
npl-1.1 | netscape public license | netscape public license {_V}1 1
qpl-1.0 | q public license | q public license {_V}1 0
php-3.0 | php license | php license {_V}3 0
php-3.01 | php license | php license {_V}3 01
psf-2.0 | python software foundation license | python software foundation license {_V}2
python-2.0 | python license | python license {_V}2 0
ruby | ruby license | ruby license
zpl-2.0 | zope public license | zope public license {_V}2 0
zpl-2.1 | zope public license | zope public license {_V}2 1
sspl-1.0 | server side public license | server side public license {_V}v?1
elastic-2.0 | elastic license | elastic license {_V}2 0
polyform-noncommercial-1.0 | polyform noncommercial license | polyform noncommercial license 1 0 0
polyform-small-business-1.0 | polyform small business license | polyform small business license 1 0 0
polyform-shield-1.0 | polyform shield license | polyform shield license 1 0 0
mulan-psl-1.0 | mulan | mulan (?:permissive software license|psl) {_V}v?1
mulan-psl-2.0 | mulan | mulan (?:permissive software license|psl) {_V}v?2
ms-pl | microsoft public license | microsoft public license
ms-rl | microsoft reciprocal license | microsoft reciprocal license
upl-1.0 | universal permissive license | universal permissive license {_V}v?1 0
vsl-1.0 | vovida software license | vovida software license {_V}1 0
w3c | w3c software | w3c software (?:notice and )?license
watcom-1.0 | watcom public license | (?:sybase open )?watcom public license {_V}1 0
odbl-1.0 | open database license | open database license {_V}v?1 0
odc-by-1.0 | attribution license | open data commons attribution license {_V}v?1 0
pddl-1.0 | public domain dedication | open data commons public domain dedication (?:and|amp) license {_V}1 0
ofl-1.0 | open font license | (?:sil )?open font license {_V}1 0
ofl-1.1 | open font license | (?:sil )?open font license {_V}1 1
ogl-uk-1.0 | open government licen | open government licen[cs]e {_V}v?1(?: 0)?
ogl-uk-2.0 | open government licen | open government licen[cs]e {_V}v?2(?: 0)?
ogl-uk-3.0 | open government licen | open government licen[cs]e {_V}v?3(?: 0)?
etalab-2.0 | licence ouverte | licence ouverte (?:open licence )?{_V}2 0
hippocratic-2.1 | hippocratic license | hippocratic license {_V}2 1
blueoak-1.0 | blue oak model license | blue oak model license 1 0 0
openrail-m | openrail | (?:bigscience |creativeml )?openrail m(?: license)?
bigcode-openrail-m | openrail | bigcode openrail m(?: license)?
cc-by-1.0 | cc by | cc by 1 0
cc-by-2.0 | cc by | cc by 2 0
cc-by-2.5 | cc by | cc by 2 5
cc-by-3.0 | cc by | cc by 3 0
cc-by-4.0 | cc by | cc by 4 0
cc-by-sa-2.0 | cc by sa | cc by sa 2 0
cc-by-sa-2.5 | cc by sa | cc by sa 2 5
cc-by-sa-3.0 | cc by sa | cc by sa 3 0
cc-by-sa-4.0 | cc by sa | cc by sa 4 0
cc-by-nd-2.0 | cc by nd | cc by nd 2 0
cc-by-nd-3.0 | cc by nd | cc by nd 3 0
cc-by-nd-4.0 | cc by nd | cc by nd 4 0
cc-by-nc-2.0 | cc by nc | cc by nc 2 0
cc-by-nc-3.0 | cc by nc | cc by nc 3 0
cc-by-nc-4.0 | cc by nc | cc by nc 4 0
cc-by-nc-sa-2.0 | cc by nc sa | cc by nc sa 2 0
cc-by-nc-sa-3.0 | cc by nc sa | cc by nc sa 3 0
cc-by-nc-sa-4.0 | cc by nc sa | cc by nc sa 4 0
cc-by-nc-nd-2.0 | cc by nc nd | cc by nc nd 2 0
cc-by-nc-nd-3.0 | cc by nc nd | cc by nc nd 3 0
cc-by-nc-nd-4.0 | cc by nc nd | cc by nc nd 4 0
cc0-1.0 | cc0 | cc0 (?:{_V}1 0|license|public domain dedication)
cc-by-3.0 | commons attribution | creative commons attribution {_V}3 0(?: unported)?
cc-by-4.0 | commons attribution | creative commons attribution {_V}4 0(?: international)?
cc-by-sa-3.0 | commons attribution | creative commons attribution share ?alike {_V}3 0(?: unported)?
cc-by-sa-4.0 | commons attribution | creative commons attribution share ?alike {_V}4 0(?: international)?
cc-by-nc-4.0 | commons attribution | creative commons attribution non ?commercial {_V}4 0(?: international)?
cc-by-nc-sa-4.0 | commons attribution | creative commons attribution non ?commercial share ?alike {_V}4 0(?: international)?
cc-by-nd-4.0 | commons attribution | creative commons attribution no ?deriv(?:ative)?s {_V}4 0(?: international)?
cc-by-nc-nd-4.0 | commons attribution | creative commons attribution non ?commercial no ?deriv(?:ative)?s {_V}4 0(?: international)?
bsd-2-clause | bsd | (?:simplified|freebsd|2 clause|two clause) bsd license
bsd-2-clause | bsd | bsd (?:2|two) clause(?: license)?
bsd-3-clause | bsd | (?:modified|revised|new|3 clause|three clause) bsd license
bsd-3-clause | bsd | bsd (?:3|three) clause(?: license)?
bsd-4-clause | bsd | (?:original|4 clause|four clause) bsd license
bsd-4-clause | bsd | bsd (?:4|four) clause(?: license)?
bsd-0-clause | bsd | (?:bsd zero clause|zero clause bsd|0bsd)(?: license)?
mit-0 | mit no attribution | mit no attribution(?: license)?
mit-modern | mit modern variant | (?:the )?mit modern variant(?: license)?
mit-cmu | cmu license | (?:mit )?cmu license
mit-feh | feh license | feh license
aal | assurance license | attribution assurance license
adsl | amazon digital services license | amazon digital services license
aml | apple mit license | apple mit license
apl-1.0 | adaptive public license | adaptive public license {_V}1 0
afl-1.1 | academic free license | academic free license {_V}1 1
afl-1.2 | academic free license | academic free license {_V}1 2
afl-2.0 | academic free license | academic free license {_V}2 0
osl-1.1 | open software license | open software license {_V}1 1
osl-2.0 | open software license | open software license {_V}2 0
apsl-1.1 | apple public source license | apple public source license {_V}1 1
apsl-1.2 | apple public source license | apple public source license {_V}1 2
bittorrent-1.0 | bittorrent open source license | bittorrent open source license {_V}1 0
bittorrent-1.1 | bittorrent open source license | bittorrent open source license {_V}1 1
catosl-1.1 | trusted open source license | computer associates trusted open source license {_V}1 1
cdla-permissive-1.0 | community data license agreement | community data license agreement permissive {_V}1 0
cdla-permissive-2.0 | community data license agreement | community data license agreement permissive {_V}2 0
cdla-sharing-1.0 | community data license agreement | community data license agreement sharing {_V}1 0
cecill-b | cecill b | cecill b(?: free software license agreement)?
cecill-c | cecill c | cecill c(?: free software license agreement)?
cern-ohl-1.1 | cern open hardware licen | cern open hardware licen[cs]e {_V}v?1 1
cern-ohl-1.2 | cern open hardware licen | cern open hardware licen[cs]e {_V}v?1 2
cern-ohl-2.0 | cern open hardware licen | cern open hardware licen[cs]e {_V}v?2(?: 0)?
cern-ohl-p-2.0 | cern ohl p | cern ohl p(?: v?2(?: 0)?)?
cern-ohl-s-2.0 | cern ohl s | cern ohl s(?: v?2(?: 0)?)?
cern-ohl-w-2.0 | cern ohl w | cern ohl w(?: v?2(?: 0)?)?
clartistic | clarified artistic license | clarified artistic license
cpol-1.02 | code project open license | code project open license (?:cpol )?{_V}1 02
cua-opl-1.0 | cua office public license | cua office public license {_V}1 0
d-fsl-1.0 | deutsche freie software lizenz | deutsche freie software lizenz
efl-1.0 | eiffel forum license | eiffel forum license {_V}1
efl-2.0 | eiffel forum license | eiffel forum license {_V}2
entessa | entessa public license | entessa public license(?: {_V}1 0)?
erlpl-1.1 | erlang public license | erlang public license {_V}1 1
eudatagrid | eu datagrid software license | eu datagrid software license
fair | fair license | fair license
frameworx-1.0 | frameworx open license | frameworx open license {_V}1 0
freetype | freetype project license | freetype project license
gfdl-1.1-or-later | free documentation license | gnu free documentation license {_V}1 1 or any later version
gfdl-1.2-or-later | free documentation license | gnu free documentation license {_V}1 2 or any later version
gfdl-1.3-or-later | free documentation license | gnu free documentation license {_V}1 3 or any later version
lgpl-2.1-or-later | general public license | gnu lesser general public license {_V}v?2 1 or (?:at your option )?any later version
lgpl-3.0-or-later | general public license | gnu lesser general public license {_V}v?3(?: 0)? or (?:at your option )?any later version
agpl-3.0-or-later | general public license | gnu affero general public license {_V}v?3(?: 0)? or (?:at your option )?any later version
gpl-2.0-classpath | classpath exception | gnu general public license {_V}v?2(?: 0)? with (?:the )?classpath exception
gpl-2.0-only | general public license | gnu general public license {_V}v?2(?: 0)? only
gpl-3.0-only | general public license | gnu general public license {_V}v?3(?: 0)? only
gsoap-1.3b | gsoap public license | gsoap public license {_V}1 3b?
hpnd | historical permission notice | historical permission notice and disclaimer
icu | icu license | icu license
intel | intel open source license | intel open source license
ipa | ipa font license | ipa font license
ijg | independent jpeg group | independent jpeg group (?:s )?license
json-evil | not evil | (?:the )?software shall be used for good not evil
liliq-p-1.1 | licence libre du qu | licence libre du qu[^ ]+ permissive {_V}1 1
liliq-r-1.1 | licence libre du qu | licence libre du qu[^ ]+ r[^ ]+ {_V}1 1
linux-openib | openib bsd license | (?:linux )?openib bsd license
lppl-1.1 | project public license | latex project public license {_V}1 1
lppl-1.2 | project public license | latex project public license {_V}1 2
miros | miros licen | (?:the )?miros licen[cs]e
motosoto | motosoto open source license | motosoto open source license
mpl-2.0-no-copyleft | secondary licenses | incompatible with secondary licenses
ms-lpl | microsoft limited public license | microsoft limited public license
ms-lrl | microsoft limited reciprocal license | microsoft limited reciprocal license
multics | multics license | multics license
naist-2003 | nara institute | nara institute of science and technology license
nasa-1.3 | nasa open source agreement | nasa open source agreement {_V}1 3
naumen | naumen public license | naumen public license
ngpl | nethack general public license | nethack general public license
nokia | nokia open source license | nokia open source license
npl-1.0 | netscape public license | netscape public license {_V}1 0
nposl-3.0 | non profit open software license | non profit open software license {_V}3 0
oclc-2.0 | oclc research public license | oclc research public license {_V}2 0
ogtsl | open group test suite license | open group test suite license
oldap-2.8 | openldap public license | openldap public license {_V}2 8
oldap | openldap public license | openldap public license
oset-2.1 | oset public license | oset public license {_V}2 1
parity-7.0 | parity public license | parity public license 7 0 0
prosperity-3.0 | prosperity public license | prosperity public license 3 0 0
polyform-internal-use-1.0 | polyform internal use license | polyform internal use license 1 0 0
polyform-perimeter-1.0 | polyform perimeter license | polyform perimeter license 1 0 0
polyform-strict-1.0 | polyform strict license | polyform strict license 1 0 0
rpl-1.1 | reciprocal public license | reciprocal public license {_V}1 1
rpl-1.5 | reciprocal public license | reciprocal public license {_V}1 5
rpsl-1.0 | realnetworks public source license | realnetworks public source license {_V}1 0
rscpl | ricoh source code public license | ricoh source code public license
sgi-b-2.0 | sgi free software license | sgi free software license b {_V}2 0
simpl-2.0 | simple public license | simple public license {_V}2 0
sissl | industry standards source license | sun industry standards source license
spl-1.0 | sun public license | sun public license {_V}1 0
tcl | tcl | tcl(?: tk)? license
ucl-1.0 | upstream compatibility license | upstream compatibility license {_V}1 0
unicode-dfs | unicode license agreement | unicode license agreement(?: data files and software)?
unicode-3.0 | unicode license | unicode license {_V}v?3
vostrom | vostrom public license | vostrom public license
x11-distribute | x11 license distribution | x11 license distribution modification variant
xnet | x net license | x net license
yahoo-1.1 | yahoo public license | yahoo public license {_V}1 1
zed | zed license | zed license
zend-2.0 | zend license | zend license {_V}2 0
zimbra-1.3 | zimbra public license | zimbra public license {_V}1 3
bsd-1-clause | bsd | (?:bsd (?:1|one) clause|(?:1|one) clause bsd)(?: license)?
bsd-2-clause-patent | bsd | bsd (?:2|two) clause plus patent(?: license)?
bsd-3-clause-clear | clear bsd license | (?:3 clause )?clear bsd license
bsd-protection | bsd protection license | bsd protection license
bsd-source-code | bsd source code attribution | bsd source code attribution
cc-by-2.0 | commons attribution | creative commons attribution {_V}2 0(?: generic)?
cc-by-2.5 | commons attribution | creative commons attribution {_V}2 5(?: generic)?
cc-by-sa-2.0 | commons attribution | creative commons attribution share ?alike {_V}2 0(?: generic)?
cc-by-sa-2.5 | commons attribution | creative commons attribution share ?alike {_V}2 5(?: generic)?
cc-by-nc-3.0 | commons attribution | creative commons attribution non ?commercial {_V}3 0(?: unported)?
cc-by-nc-sa-3.0 | commons attribution | creative commons attribution non ?commercial share ?alike {_V}3 0(?: unported)?
cc-by-nd-3.0 | commons attribution | creative commons attribution no ?deriv(?:ative)?s {_V}3 0(?: unported)?
cc-by-nc-nd-3.0 | commons attribution | creative commons attribution non ?commercial no ?deriv(?:ative)?s {_V}3 0(?: unported)?
llama-2 | llama | (?:meta )?llama 2 community license(?: agreement)?
llama-3 | llama | (?:meta )?llama 3(?: [123])? community license(?: agreement)?
gemma | gemma terms of use | gemma terms of use
bigscience-rail-1.0 | bigscience | bigscience (?:bloom )?rail (?:license )?{_V}1 0
fsl-1.1 | functional source license | functional source license {_V}1 1
commons-clause | commons clause | (?:the )?commons clause license condition(?: {_V}1 0)?
"""

#: Sentences of the licences' own texts.
_TEXTS = r"""
mit | permission is hereby granted | permission is hereby granted free of charge to any person obtaining a copy of this software
isc | permission to use | permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee
bsd-2-clause | redistribution and use | redistribution and use in source and binary forms with or without modification are permitted
apache-2.0 | you may not use this file | you may not use this file except in compliance with the license
apache-2.0 | www apache org licenses | (?:http |https )?www apache org licenses license 2 0
gpl-2.0-or-later | free software foundation | free software foundation either version 2 of the license or (?:at your option )?any later version
gpl-3.0-or-later | free software foundation | free software foundation either version 3 of the license or (?:at your option )?any later version
gpl | gnu org licenses | (?:http |https )?www gnu org licenses gpl
agpl-3.0 | gnu org licenses | (?:http |https )?www gnu org licenses agpl
lgpl | gnu org licenses | (?:http |https )?www gnu org licenses lgpl
mpl-2.0 | this source code form | this source code form is subject to the terms of the mozilla public license
unlicense | free and unencumbered software | this is free and unencumbered software released into the public domain
wtfpl | do what the fuck | do what the fuck you want to public license
zlib | this software is provided | this software is provided as is without any express or implied warranty
cc0-1.0 | publicdomain zero | creativecommons org publicdomain zero 1 0
cc-by-4.0 | creativecommons org licenses | creativecommons org licenses by 4 0
cc-by-3.0 | creativecommons org licenses | creativecommons org licenses by 3 0
cc-by-sa-4.0 | creativecommons org licenses | creativecommons org licenses by sa 4 0
cc-by-sa-3.0 | creativecommons org licenses | creativecommons org licenses by sa 3 0
cc-by-nc-4.0 | creativecommons org licenses | creativecommons org licenses by nc 4 0
cc-by-nc-sa-4.0 | creativecommons org licenses | creativecommons org licenses by nc sa 4 0
cc-by-nd-4.0 | creativecommons org licenses | creativecommons org licenses by nd 4 0
cc-by-nc-nd-4.0 | creativecommons org licenses | creativecommons org licenses by nc nd 4 0
public-domain | public domain | (?:placed|released|dedicated) (?:in|into|to) the public domain
proprietary | all rights reserved | copyright (?:c )?(?:[0-9]{4} )?[^ ]+ all rights reserved
proprietary | unauthorized copying | unauthorized copying of this (?:file|work|document) (?:via any medium )?is strictly prohibited
"""

#: Names without a version.
_NAMES = r"""
gpl | general public license | gnu general public license
lgpl | general public license | gnu (?:lesser|library) general public license
agpl | general public license | gnu affero general public license
gfdl | free documentation license | gnu free documentation license
apache | apache license | apache license
apache | apache software license | apache software license
mpl | mozilla public license | mozilla public license
epl | eclipse public license | eclipse public license
cddl | development and distribution license | common development and distribution license
eupl | european union public licen | european union public licen[cs]e
bsl | boost software license | boost software license
artistic | artistic license | artistic license
afl | academic free license | academic free license
osl | open software license | open software license
mit | mit licen | mit licen[cs]e
mit | expat license | expat license
mit-x11 | x11 license | (?:mit )?x11 license
isc | isc license | isc license
zlib | zlib license | zlib license
bsd | bsd | bsd (?:style )?license
python | python software foundation license | python software foundation license
php | php license | php license
unlicense | unlicense | (?:the )?unlicense(?:d license)?
wtfpl | wtfpl | wtfpl(?: license)?
beerware | beerware license | beerware license
postgresql | postgresql license | postgresql license
openssl | openssl license | openssl license
sleepycat | sleepycat license | sleepycat license
ncsa | ncsa open source license | (?:university of illinois )?ncsa open source license
curl | curl license | curl license
libpng | libpng license | libpng license
imagemagick | imagemagick license | imagemagick license
json | json license | (?:the )?json license
vim | vim license | vim license
ofl | open font license | (?:sil )?open font license
odbl | open database license | open database license
ogl | open government licen | open government licen[cs]e
etalab | licence ouverte | licence ouverte
llama | llama | llama (?:[23] )?community license
cc-by-sa | cc by sa | cc by sa
cc-by-nd | cc by nd | cc by nd
cc-by-nc | cc by nc | cc by nc
cc-by-nc-sa | cc by nc sa | cc by nc sa
cc-by-nc-nd | cc by nc nd | cc by nc nd
cc-by | commons attribution | creative commons attribution
cc-by-sa | commons attribution | creative commons attribution share ?alike
cc-by-nc | commons attribution | creative commons attribution non ?commercial
cc | creative commons | creative commons licen[cs]e
cc0 | cc0 | cc0
public-domain | public domain | public domain(?: dedication)?
"""

#: Notices that point at some licence without saying which.
_HINTS = r"""
unknown-license | licensed under | licensed under the terms of
unknown-license | licensed under | licensed under (?:the |a |an )?[^ ]+ licen[cs]e
unknown-license | released under | released under (?:the |a |an )?[^ ]+ licen[cs]e
unknown-license | distributed under | distributed under (?:the |a |an )?[^ ]+ licen[cs]e
unknown-license | see the license | see the license file for
proprietary | all rights reserved | all rights reserved
"""

#: Priority and confidence of each block; identifier tags come first of all.
_BLOCKS = [(_TITLES, 1, 0.98), (_TEXTS, 2, 0.95), (_NAMES, 3, 0.85), (_HINTS, 4, 0.4)]


def _rules() -> list[Rule]:
    lines = [(p, c, *[x.strip() for x in line.split(" | ")]) for block, p, c in _BLOCKS for line in block.strip().splitlines()]
    labels = list(dict.fromkeys(label for _, _, label, _, _ in lines if label not in ("unknown-license", "proprietary")))
    tags = [(0, 1.0, label, "spdx license identifier", f"spdx license identifier {label.replace('-', ' ').replace('.', ' ')}(?: only)?") for label in labels]
    return [Rule(i, *x) for i, x in enumerate([*tags, *lines])]


RULES = _rules()


def stem(rule: Rule) -> str:
    """Text inside one word that every match of the rule contains, whatever stands between words."""
    if "licen" in rule.keyword or rule.pattern.endswith(("licen[cs]e", "license")):
        return "licen"
    return max(rule.keyword.split(" "), key=len)
