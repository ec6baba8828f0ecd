"""Operator 1: license scans by ordered signature rules.

A rule is a regular expression, written by hand for a notice or a sentence of a license, over the words of a text
joined by single spaces. It has a keyword that must be in the text before the expression is tried, a priority and a
weight; one pass of an Aho-Corasick automaton over the text tells which keywords it has. Where the expression has a
group, that is the version, and the label gets it. Detections are intervals of words; one that lies in the interval
of an accepted detection of a higher rank is suppressed, in time that grows as n log n with their number.

Defined cases: a null or empty text has no words and no detections (score 0, labels empty); ties in
priority go to the longer interval, then the earlier start, then the order of the rules; rows that
repeat are each scanned; other columns are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import accumulate

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from inkstone.llm.common import arrow_map, table, utf8_view, word_counts


@dataclass(frozen=True)
class Rule:
    name: str
    label: str
    keyword: str
    pattern: str
    priority: int
    weight: float
    base: bool = False


#: Phrases and labels of the base rules.
BASE_RULES = (("cc by", "cc-by", "cc"), ("general public license", "gpl", "general"), ("all rights reserved", "reserved", "reserved"))

#: Signatures as "label keyword priority weight expression". The group of an expression is the version of its license.
SIGNATURES = r"""
apache-2.0 apache 95 0.99 licen[sc]ed under the apache licen[sc]e version 2 0
apache apache 92 0.95 (?:licen[sc]ed|released|distributed|available|provided|published|covered) under (?:the )?(?:terms of )?(?:the )?apache(?: software)?(?: licen[sc]e)?(?: version| v)? ?v?(1 0|1 1|2 0|2)?
apache apache 85 0.95 apache(?: software)? licen[sc]e(?: version| v)? ?v?(1 0|1 1|2 0|2)
apache apache 60 0.75 apache(?: software)? licen[sc]e
apache-2.0 apache 90 0.95 you may not use this file except in compliance with the licen[sc]e you may obtain a copy of the licen[sc]e at (?:http|https) www apache org licen[sc]es licen[sc]e 2 0
apache-2.0 apache 80 0.95 (?:http|https) www apache org licen[sc]es licen[sc]e 2 0
apache-2.0 compliance 74 0.8 you may not use this file except in compliance with the licen[sc]e
apache-2.0 governing 72 0.75 see the licen[sc]e for the specific language governing permissions and limitations under the licen[sc]e
apache-2.0 conditions 71 0.75 distributed on an as is basis without warranties or conditions of any kind either express or implied
apache-2.0 patent 78 0.85 each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable except as stated in this section patent licen[sc]e
apache-2.0 irrevocable 77 0.85 each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright licen[sc]e
apache-1.1 apache 82 0.9 this product includes software developed by the apache software foundation
apache-1.1 apache 80 0.85 the names apache (?:server|software foundation|group) .{0,60}?must not be used to endorse or promote products
mit mit 92 0.95 (?:licen[sc]ed|released|distributed|available|provided|published|covered) under (?:the )?(?:terms of )?(?:the )?mit(?: x11| expat)?(?: licen[sc]e)?
mit mit 75 0.85 (?:the )?mit(?: open source)? licen[sc]e
mit mit 74 0.85 licen[sc]e mit
mit hereby 88 0.95 permission is hereby granted free of charge to any person obtaining a copy
mit substantial 84 0.9 the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit sublicense 83 0.9 the rights to use copy modify merge publish distribute sublicense and or sell copies of the software
mit merchantability 70 0.8 without warranty of any kind express or implied including but not limited to the warranties of merchantability
mit tort 69 0.75 whether in an action of contract tort or otherwise arising from out of or in connection with the software
mit-0 attribution 88 0.9 mit no attribution
x11 consortium 84 0.9 except as contained in this notice the name of the x consortium shall not be used in advertising
x11 x11 75 0.8 x11 licen[sc]e
expat expat 75 0.8 expat licen[sc]e
bsd bsd 92 0.95 (?:licen[sc]ed|released|distributed|available|provided|published|covered) under (?:the )?(?:terms of )?(?:the )?(?:new |modified |simplified |revised )?bsd(?: style)?(?: licen[sc]e)?
bsd-2-clause bsd 93 0.95 (?:simplified bsd|bsd 2 clause|2 clause bsd|two clause bsd)(?: licen[sc]e)?
bsd-3-clause bsd 93 0.95 (?:new bsd|modified bsd|revised bsd|bsd 3 clause|3 clause bsd|three clause bsd)(?: licen[sc]e)?
bsd-4-clause bsd 93 0.95 (?:original bsd|bsd 4 clause|4 clause bsd|four clause bsd)(?: licen[sc]e)?
0bsd bsd 93 0.95 (?:zero clause bsd|bsd zero clause|0bsd)(?: licen[sc]e)?
bsd bsd 70 0.8 bsd(?: style)? licen[sc]e
bsd redistribution 88 0.95 redistribution and use in source and binary forms with or without modification are permitted
bsd redistributions 80 0.85 redistributions of source code must retain the (?:above )?copyright notice this list of conditions and the following disclaimer
bsd redistributions 79 0.85 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer
bsd-3-clause endorse 82 0.9 neither the names? of .{1,120}? nor the names of (?:its|their|any) contributors may be used to endorse or promote products derived from this software
bsd-4-clause advertising 84 0.9 all advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd exemplary 68 0.75 be liable for any direct indirect incidental special exemplary or consequential damages
bsd-3-clause-clear patent 85 0.9 no express or implied licen[sc]es to any party s patent rights are granted by this licen[sc]e
bsd-2-clause-freebsd freebsd 84 0.85 freebsd licen[sc]e
bsd-3-clause-lbnl berkeley 80 0.85 lawrence berkeley national laboratory .{0,60}?licen[sc]e
bsd regents 76 0.85 the regents of the university of california
isc isc 92 0.95 (?:licen[sc]ed|released|distributed|available|provided|published|covered) under (?:the )?(?:terms of )?(?:the )?isc(?: licen[sc]e)?
isc isc 75 0.85 isc licen[sc]e
isc granted 88 0.95 permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted
isc disclaims 70 0.75 the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness
hpnd supporting 82 0.85 appear in all copies and that both that copyright notice and this permission notice appear in supporting documentation
ntp advertising 80 0.85 not be used in advertising or publicity pertaining to distribution of the software without specific written prior permission
gpl general 95 0.98 (?:licen[sc]ed|released|distributed|available|provided|published|covered) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?general public licen[sc]e(?: version| v)? ?v?(1 0|1|2 0|2|3 0|3)?(?: or later| only)?
gpl gpl 94 0.97 (?:licen[sc]ed|released|distributed|available|provided|published|covered) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?gpl(?: licen[sc]e)?(?: version| v)? ?v?(1 0|1|2 0|2|3 0|3)?(?: or later| only)?
gpl general 86 0.95 (?:gnu )?general public licen[sc]e(?: as published by the free software foundation)?(?: either)?(?: version| v) ?v?(1 0|1|2 0|2|3 0|3)
gpl gnu 72 0.9 gnu general public licen[sc]e
gpl gnu 60 0.8 gnu gpl
gpl gpl 65 0.8 gpl ?v?(1 0|1|2 0|2|3 0|3)(?: or later| only)?
gpl gpl 62 0.8 gpl licen[sc]e
gpl redistribute 91 0.95 (?:it|you) can redistribute it and or modify it under the terms of the gnu general public licen[sc]e
gpl foundation 83 0.9 as published by the free software foundation either version (1|2|3) of the licen[sc]e or at your option any later version
gpl received 80 0.85 you should have received a copy of the gnu general public licen[sc]e along with this program
gpl foundation 76 0.8 write to the free software foundation inc (?:59 temple place suite 330|51 franklin street fifth floor|675 mass ave)
gpl useful 74 0.8 this program is distributed in the hope that it will be useful but without any warranty
gpl absolutely 73 0.8 comes with absolutely no warranty
gpl-2.0 verbatim 78 0.8 everyone is permitted to copy and distribute verbatim copies of this licen[sc]e document but changing it is not allowed
gpl-2.0-classpath classpath 90 0.9 (?:with the )?(?:gnu )?classpath exception
gpl-3.0 tivo 70 0.6 tivoization
gpl copyleft 50 0.6 this is a copyleft licen[sc]e
lgpl lesser 95 0.98 (?:licen[sc]ed|released|distributed|available|provided|published|covered) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?lesser general public licen[sc]e(?: version| v)? ?v?(2 1|2|3 0|3)?(?: or later| only)?
lgpl lgpl 94 0.97 (?:licen[sc]ed|released|distributed|available|provided|published|covered) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?lgpl(?: licen[sc]e)?(?: version| v)? ?v?(2 0|2 1|2|3 0|3)?(?: or later| only)?
lgpl lesser 88 0.95 (?:gnu )?lesser general public licen[sc]e(?: version| v)? ?v?(2 1|2|3 0|3)?
lgpl library 88 0.95 (?:gnu )?library general public licen[sc]e(?: version| v)? ?v?(2 0|2)?
lgpl lgpl 66 0.8 lgpl ?v?(2 0|2 1|2|3 0|3)?
lgpl lesser 92 0.95 can redistribute it and or modify it under the terms of the gnu lesser general public licen[sc]e
lgpl library 82 0.85 this library is free software you can redistribute it
lgpl library 70 0.75 a work that uses the library
agpl affero 95 0.98 (?:licen[sc]ed|released|distributed|available|provided|published|covered) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?affero general public licen[sc]e(?: version| v)? ?v?(1 0|1|3 0|3)?(?: or later| only)?
agpl affero 89 0.95 (?:gnu )?affero general public licen[sc]e(?: version| v)? ?v?(1 0|1|3 0|3)?
agpl agpl 68 0.85 agpl ?v?(1 0|1|3 0|3)?
agpl-3.0 network 76 0.8 offer all users interacting with it remotely through a computer network
gfdl documentation 90 0.95 (?:gnu )?free documentation licen[sc]e(?: version| v)? ?v?(1 1|1 2|1 3)?
gfdl invariant 80 0.85 with no invariant sections no front cover texts and no back cover texts
gfdl gfdl 66 0.8 gfdl ?v?(1 1|1 2|1 3)?
mpl mozilla 95 0.97 (?:subject to|under) the terms of the mozilla public licen[sc]e(?: version| v) ?v?(1 0|1 1|2 0)
mpl mozilla 86 0.95 mozilla public licen[sc]e(?: version| v)? ?v?(1 0|1 1|2 0)?
mpl-2.0 mozilla 90 0.95 if a copy of the mpl was not distributed with this file you can obtain one at (?:http|https) mozilla org mpl 2 0
mpl-2.0 incompatible 84 0.9 this source code form is incompatible with secondary licen[sc]es
mpl-1.1 initial 82 0.85 the initial developer of the original code is
mpl mpl 64 0.8 mpl ?v?(1 0|1 1|2 0)
npl netscape 84 0.9 netscape public licen[sc]e(?: version| v)? ?v?(1 0|1 1)?
epl eclipse 88 0.95 eclipse public licen[sc]e(?: version| v)? ?v?(1 0|2 0)?
epl eclipse 90 0.95 this program and the accompanying materials are made available under the terms of the eclipse public licen[sc]e ?v?(1 0|2 0)?
edl eclipse 88 0.95 eclipse distribution licen[sc]e(?: version| v)? ?v?(1 0)?
cddl common 88 0.95 common development and distribution licen[sc]e(?: version| v)? ?v?(1 0|1 1)?
cddl cddl 66 0.8 cddl ?v?(1 0|1 1)?
cddl contents 74 0.75 the contents of this file are subject to the terms of the common development and distribution licen[sc]e
cpl common 88 0.95 common public licen[sc]e(?: version| v)? ?v?(0 5|1 0)?
ipl ibm 88 0.95 ibm public licen[sc]e(?: version| v)? ?v?(1 0)?
eupl european 88 0.95 european union public licen[sc]e(?: version| v)? ?v?(1 0|1 1|1 2)?
eupl eupl 66 0.8 eupl ?v?(1 0|1 1|1 2)?
osl open 86 0.9 open software licen[sc]e(?: version| v)? ?v?(1 0|1 1|2 0|2 1|3 0)?
afl academic 86 0.9 academic free licen[sc]e(?: version| v)? ?v?(1 1|1 2|2 0|2 1|3 0)?
ecl educational 86 0.9 educational community licen[sc]e(?: version| v)? ?v?(1 0|2 0)?
artistic artistic 86 0.9 (?:perl )?artistic licen[sc]e(?: version| v)? ?v?(1 0|2 0)?
artistic perl 84 0.9 under the same terms as perl itself
clarified-artistic clarified 87 0.9 clarified artistic licen[sc]e
boost boost 88 0.95 boost software licen[sc]e(?: version| v)? ?v?(1 0)?
boost-1.0 machine 80 0.85 solely in the form of machine executable object code generated by a source language processor
python python 88 0.95 python software foundation licen[sc]e(?: version| v)? ?v?(2 0|2)?
python psf 84 0.9 psf licen[sc]e agreement for python ?(2 0|2|3)?
python-cnri cnri 84 0.9 cnri (?:open source )?licen[sc]e agreement
php php 86 0.9 php licen[sc]e(?: version| v)? ?v?(3 0|3 01)?
php php 82 0.85 this product includes php software freely available from
zend zend 86 0.9 zend (?:engine )?licen[sc]e(?: version| v)? ?v?(2 0)?
ruby ruby 84 0.85 ruby(?: s)? licen[sc]e
ruby ruby 84 0.85 under the same terms as ruby
zlib zlib 84 0.9 zlib(?: libpng)? licen[sc]e
zlib misrepresented 88 0.95 the origin of this software must not be misrepresented you must not claim that you wrote the original software
zlib altered 82 0.85 altered source versions must be plainly marked as such
libpng libpng 82 0.85 libpng licen[sc]e(?: version| v)? ?v?(1|2)?
ijg jpeg 84 0.9 this software is based in part on the work of the independent jpeg group
unlicense unencumbered 92 0.95 this is free and unencumbered software released into the public domain
unlicense unlicense 86 0.9 (?:the )?unlicense
wtfpl fuck 90 0.95 do what the fuck you want to(?: public licen[sc]e)?(?: version| v)? ?v?(1|2)?
wtfpl wtfpl 80 0.9 wtfpl
beerware beer 88 0.95 you can buy me a beer in return
beerware beer 84 0.85 beer ?ware licen[sc]e
jsonlic evil 86 0.9 the software shall be used for good not evil
ofl open 88 0.95 sil open font licen[sc]e(?: version| v)? ?v?(1 0|1 1)?
ofl reserved 74 0.8 with reserved font names?
ofl-1.1 font 80 0.85 the font software may be sold as part of a larger software package
bitstream-vera bitstream 86 0.9 bitstream vera
lppl latex 88 0.95 latex project public licen[sc]e(?: version| v)? ?v?(1 0|1 1|1 2|1 3|1 3a|1 3c)?
lppl-1.3 maintenance 78 0.8 this work has the lppl maintenance status
ms-pl microsoft 88 0.95 microsoft public licen[sc]e
ms-rl microsoft 88 0.95 microsoft reciprocal licen[sc]e
ms-limited microsoft 84 0.9 microsoft limited public licen[sc]e
postgresql postgresql 84 0.9 postgresql licen[sc]e
postgresql california 82 0.85 in no event shall the university of california be liable to any party
ncsa illinois 88 0.95 university of illinois ncsa open source licen[sc]e
ncsa ncsa 80 0.85 ncsa open source licen[sc]e
qpl public 84 0.85 q public licen[sc]e(?: version| v)? ?v?(1 0)?
sleepycat sleepycat 86 0.9 sleepycat(?: public)? licen[sc]e
vim vim 84 0.85 vim licen[sc]e
vim charityware 80 0.8 vim is charityware
w3c w3c 86 0.9 w3c software(?: notice)?(?: and document)? (?:notice and )?licen[sc]e
tcl tcl 84 0.85 tcl(?: tk)? licen[sc]e
openssl openssl 86 0.9 openssl(?: ssleay)? licen[sc]e
openssl openssl 84 0.9 this product includes software developed by the openssl project
ssleay cryptographic 84 0.9 this product includes cryptographic software written by eric young
curl curl 82 0.85 curl licen[sc]e
icu icu 82 0.85 icu licen[sc]e
unicode unicode 84 0.9 unicode (?:inc )?licen[sc]e agreement data files and software
upl universal 86 0.9 universal permissive licen[sc]e(?: version| v)? ?v?(1 0)?
mulan mulan 86 0.9 mulan (?:permissive software licen[sc]e|psl)(?: version| v)? ?v?(1|2)?
cecill cecill 86 0.9 cecill(?: b| c)?(?: free software)?(?: licen[sc]e)?(?: agreement)?(?: version| v)? ?v?(1 0|1 1|2 0|2 1)?
sspl server 88 0.95 server side public licen[sc]e(?: version| v)? ?v?(1)?
bsl business 88 0.95 business source licen[sc]e(?: version| v)? ?v?(1 0|1 1)?
bsl additional 74 0.75 the additional use grant
elastic elastic 86 0.9 elastic licen[sc]e(?: version| v)? ?v?(1 0|2|2 0)?
confluent confluent 86 0.9 confluent community licen[sc]e(?: agreement)?(?: version| v)? ?v?(1 0)?
commons-clause commons 88 0.9 commons clause licen[sc]e condition(?: v)? ?v?(1 0)?
polyform polyform 88 0.9 polyform (?:noncommercial|shield|strict|small business|perimeter) licen[sc]e ?(1 0 0)?
prosperity prosperity 84 0.85 prosperity public licen[sc]e(?: version| v)? ?v?(2 0 0|3 0 0)?
parity parity 84 0.85 parity public licen[sc]e(?: version| v)? ?v?(6 0 0|7 0 0)?
blueoak blue 86 0.9 blue oak model licen[sc]e(?: version| v)? ?v?(1 0 0)?
rpl reciprocal 84 0.85 reciprocal public licen[sc]e(?: version| v)? ?v?(1 1|1 5)?
watcom watcom 84 0.85 sybase open watcom public licen[sc]e(?: version| v)? ?v?(1 0)?
apsl apple 86 0.9 apple public source licen[sc]e(?: version| v)? ?v?(1 0|1 1|1 2|2 0)?
nasa nasa 86 0.9 nasa open source agreement(?: version| v)? ?v?(1 3)?
nokia nokia 84 0.85 nokia open source licen[sc]e
intel intel 80 0.85 intel open source licen[sc]e
lucent lucent 84 0.85 lucent public licen[sc]e(?: version| v)? ?v?(1 0|1 02)?
spl sun 84 0.85 sun public licen[sc]e(?: version| v)? ?v?(1 0)?
sissl sun 84 0.85 sun industry standards source licen[sc]e(?: version| v)? ?v?(1 1|1 2)?
odbl open 88 0.95 open (?:data commons open )?database licen[sc]e(?: version| v)? ?v?(1 0)?
odc-by open 88 0.95 open data commons attribution licen[sc]e(?: version| v)? ?v?(1 0)?
pddl public 88 0.95 (?:open data commons )?public domain dedication and licen[sc]e(?: version| v)? ?v?(1 0)?
ogl government 86 0.9 open government licen[sc]e(?: version| v)? ?v?(1 0|2 0|3 0)?
ogl sector 76 0.8 contains public sector information licen[sc]ed under the open government licen[sc]e
etalab ouverte 84 0.85 licence ouverte(?: open licence)?(?: etalab)?(?: version)? ?(1 0|2 0)?
dl-de datenlizenz 84 0.85 datenlizenz deutschland (?:namensnennung|zero)(?: version)? ?(1 0|2 0)?
cdla community 86 0.9 community data licen[sc]e agreement (?:permissive|sharing)(?: version)? ?(1 0|2 0)?
openrail openrail 86 0.9 (?:creativeml |bigscience |bigcode )?openrail(?: m| rail)?(?: licen[sc]e)?
rail responsible 82 0.85 responsible ai licen[sc]e
llama llama 88 0.9 llama (?:2|3|3 1|3 2)? ?community licen[sc]e agreement
gemma gemma 84 0.85 gemma is provided under and subject to the gemma terms of use
free-art free 86 0.9 free art licen[sc]e(?: version)? ?(1 2|1 3)?
design-science design 84 0.85 design science licen[sc]e
opl open 84 0.85 open publication licen[sc]e(?: version| v)? ?v?(0 4|1 0)?
opl-ogc open 84 0.85 open gam(?:e|ing) licen[sc]e(?: version| v)? ?v?(1 0a?)?
cern cern 86 0.9 cern open hardware licen[sc]e(?: version| v)? ?v?(1 1|1 2|2)?
tapr tapr 84 0.85 tapr open hardware licen[sc]e
solderpad solderpad 84 0.85 solderpad hardware licen[sc]e(?: version| v)? ?v?(0 5|0 51|2 0|2 1)?
gutenberg gutenberg 88 0.95 (?:the )?(?:full )?project gutenberg(?: tm)? licen[sc]e
gutenberg ebook 84 0.85 this ebook is for the use of anyone anywhere (?:at no cost|in the united states)
spdx spdx 100 0.99 spdx licen[sc]e identifier [a-z0-9]+(?: [0-9]+)*(?: or later| only| clause)?
apache-2.0 spdx 102 0.99 spdx licen[sc]e identifier apache 2 0
mit spdx 102 0.99 spdx licen[sc]e identifier mit
bsd-2-clause spdx 102 0.99 spdx licen[sc]e identifier bsd 2 clause
bsd-3-clause spdx 102 0.99 spdx licen[sc]e identifier bsd 3 clause
isc spdx 102 0.99 spdx licen[sc]e identifier isc
gpl spdx 102 0.99 spdx licen[sc]e identifier gpl (1 0|2 0|3 0)(?: or later| only)?
lgpl spdx 102 0.99 spdx licen[sc]e identifier lgpl (2 0|2 1|3 0)(?: or later| only)?
agpl spdx 102 0.99 spdx licen[sc]e identifier agpl (1 0|3 0)(?: or later| only)?
mpl spdx 102 0.99 spdx licen[sc]e identifier mpl (1 0|1 1|2 0)
epl spdx 102 0.99 spdx licen[sc]e identifier epl (1 0|2 0)
cc0 spdx 102 0.99 spdx licen[sc]e identifier cc0 1 0
cc-by spdx 102 0.99 spdx licen[sc]e identifier cc by (1 0|2 0|2 5|3 0|4 0)
cc-by-sa spdx 102 0.99 spdx licen[sc]e identifier cc by sa (1 0|2 0|2 5|3 0|4 0)
unlicense spdx 102 0.99 spdx licen[sc]e identifier unlicense
cc-by creative 88 0.95 creative commons attribution(?: licen[sc]e)?(?: version)? ?(1 0|2 0|2 5|3 0|4 0)?(?: international| unported| generic)?
cc-by-sa creative 90 0.95 creative commons attribution (?:sharealike|share alike)(?: licen[sc]e)?(?: version)? ?(1 0|2 0|2 5|3 0|4 0)?(?: international| unported| generic)?
cc-by-nd creative 90 0.95 creative commons attribution (?:noderivatives|noderivs|no derivatives|no derivs)(?: licen[sc]e)?(?: version)? ?(1 0|2 0|2 5|3 0|4 0)?(?: international| unported| generic)?
cc-by-nc creative 90 0.95 creative commons attribution (?:noncommercial|non commercial)(?: licen[sc]e)?(?: version)? ?(1 0|2 0|2 5|3 0|4 0)?(?: international| unported| generic)?
cc-by-nc-sa creative 91 0.95 creative commons attribution (?:noncommercial|non commercial) (?:sharealike|share alike)(?: licen[sc]e)?(?: version)? ?(1 0|2 0|2 5|3 0|4 0)?(?: international| unported| generic)?
cc-by-nc-nd creative 91 0.95 creative commons attribution (?:noncommercial|non commercial) (?:noderivatives|noderivs|no derivatives|no derivs)(?: licen[sc]e)?(?: version)? ?(1 0|2 0|2 5|3 0|4 0)?(?: international| unported| generic)?
cc-by cc 80 0.9 cc by (1 0|2 0|2 5|3 0|4 0)
cc-by-sa cc 82 0.9 cc by sa ?(1 0|2 0|2 5|3 0|4 0)?
cc-by-nd cc 82 0.9 cc by nd ?(1 0|2 0|2 5|3 0|4 0)?
cc-by-nc cc 82 0.9 cc by nc ?(1 0|2 0|2 5|3 0|4 0)?
cc-by-nc-sa cc 83 0.9 cc by nc sa ?(1 0|2 0|2 5|3 0|4 0)?
cc-by-nc-nd cc 83 0.9 cc by nc nd ?(1 0|2 0|2 5|3 0|4 0)?
cc-by creativecommons 84 0.9 creativecommons org licen[sc]es by (1 0|2 0|2 5|3 0|4 0)
cc-by-sa creativecommons 85 0.9 creativecommons org licen[sc]es by sa (1 0|2 0|2 5|3 0|4 0)
cc-by-nd creativecommons 85 0.9 creativecommons org licen[sc]es by nd (1 0|2 0|2 5|3 0|4 0)
cc-by-nc creativecommons 85 0.9 creativecommons org licen[sc]es by nc (1 0|2 0|2 5|3 0|4 0)
cc-by-nc-sa creativecommons 86 0.9 creativecommons org licen[sc]es by nc sa (1 0|2 0|2 5|3 0|4 0)
cc-by-nc-nd creativecommons 86 0.9 creativecommons org licen[sc]es by nc nd (1 0|2 0|2 5|3 0|4 0)
cc0 creativecommons 85 0.9 creativecommons org publicdomain zero (1 0)
cc0 creative 88 0.95 creative commons (?:zero|cc0|public domain dedication)(?: 1 0)?
cc0 cc0 70 0.85 cc0(?: 1 0)?(?: universal)?
cc0 waived 78 0.85 has waived all copyright and related or neighboring rights to
cc creative 55 0.6 (?:under a )?creative commons licen[sc]e
cc-by-nc noncommercial 52 0.6 for noncommercial (?:use|purposes) only
public-domain domain 75 0.9 (?:released|placed|dedicated|dedicate|is|are) (?:in|into|to) the public domain
public-domain domain 50 0.6 public domain (?:work|notice|mark)
public-domain disclaims 74 0.8 the author disclaims copyright to this source code
public-domain restrictions 72 0.8 no known copyright restrictions
us-government government 74 0.8 this is a work of the (?:us|u s|united states) government
copyright copyright 45 0.6 copyright (?:c )?(?:by )?(?:19|20)\d\d
copyright copyrighted 40 0.5 copyrighted (?:by|material|work)
copyright copr 40 0.5 copr (?:19|20)\d\d
copyright tous 45 0.6 tous droits réservés
copyright rechte 45 0.6 alle rechte vorbehalten
copyright derechos 45 0.6 (?:todos los derechos|derechos) reservados
copyright diritti 45 0.6 tutti i diritti riservati
reserved reserved 55 0.6 (?:some|no) rights reserved
proprietary proprietary 60 0.75 proprietary and confidential
proprietary confidential 58 0.7 confidential and proprietary
proprietary prohibited 62 0.8 unauthori[sz]ed copying of this (?:file|software|document) via any medium is strictly prohibited
proprietary written 56 0.7 may not be (?:copied|reproduced|redistributed|published)(?: or (?:copied|reproduced|redistributed|published))* without (?:the )?(?:prior |express )?written (?:permission|consent)
proprietary trade 60 0.75 contains trade secrets
proprietary evaluation 50 0.6 for evaluation (?:purposes|use) only
proprietary personal 45 0.5 for personal use only
proprietary internal 45 0.5 for internal use only
eula agreement 60 0.7 end user licen[sc]e agreement
eula installing 56 0.65 by installing (?:or using )?(?:the|this) software you agree to (?:be bound by )?the(?:se)? terms
tos terms 45 0.5 terms of (?:service|use) apply
shareware shareware 45 0.5 this (?:program|software) is shareware
freeware freeware 45 0.5 this (?:program|software) is freeware
commercial commercial 45 0.5 commercial licen[sc]e (?:is )?(?:available|required)
dual-license dual 50 0.6 dual licen[sc]ed under
dco developer 45 0.5 developer certificate of origin(?: version)? ?(1 0|1 1)?
noai train 55 0.6 may not be used (?:to train|for training)(?: of)?(?: any)? (?:ai|artificial intelligence|machine learning)
robots mining 50 0.5 text and data mining (?:rights )?reserved
unknown-license licen 30 0.5 licen[sc]ed under (?:the|a|an) [^ ]+ licen[sc]e
unknown-license licen 28 0.45 (?:see|refer to) (?:the )?(?:accompanying )?licen[sc]e (?:file )?for (?:details|more information|terms)
unknown-license licen 26 0.4 use of this (?:source code|software|file) is governed by (?:a|an|the)(?: [^ ]+){0,3}? licen[sc]e
unknown-license licen 24 0.4 (?:released|distributed|available|provided|published|covered) under (?:the )?(?:terms of )?(?:the )?[^ ]+ licen[sc]e
warranty warranty 35 0.4 without (?:any )?warranty of any kind
warranty merchantability 36 0.4 implied warrant(?:y|ies) of merchantability (?:or|and) fitness for a particular purpose
warranty liable 34 0.4 in no event shall the (?:authors?|copyright holders?|contributors?|regents)(?: or (?:authors?|copyright holders?|contributors?))* be liable
"""


@cache
def rules() -> tuple[Rule, ...]:
    """All rules, highest priority first; of one priority in the order of the tables."""
    out = [Rule(f"base {label}", label, key, phrase, 50, 0.7, True) for phrase, label, key in BASE_RULES]
    for i, line in enumerate(SIGNATURES.strip().splitlines()):
        label, key, priority, weight, pattern = line.split(" ", 4)
        out.append(Rule(f"signature {i}", label, key, pattern, int(priority), float(weight)))
    return tuple(sorted(out, key=lambda r: -r.priority))


@cache
def compiled() -> tuple[ahocorasick.Automaton, dict[str, list[tuple[int, Rule, re.Pattern]]]]:
    """The automaton of the keywords, and the rules of each."""
    found: dict[str, list] = {}
    for rank, rule in enumerate(rules()):
        found.setdefault(rule.keyword, []).append((rank, rule, re.compile(f"(?<= ){rule.pattern}(?= )")))
    keywords = ahocorasick.Automaton()
    for k in found:
        keywords.add_word(k, k)
    keywords.make_automaton()
    return keywords, found


LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
WORDS = re.compile(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def gated(lowered: bytes) -> list[tuple[int, Rule, re.Pattern]]:
    """Rules whose keyword is in the text."""
    keywords, found = compiled()
    return [rule for k in sorted({k for _, k in keywords.iter(lowered.decode("latin-1"))}) for rule in found[k]]


@dataclass(frozen=True)
class Detection:
    rule: Rule
    label: str
    rank: int
    start: int
    end: int
    kept: bool


class Cover:
    """Intervals, of which only those that no other contains are held: starts and ends both ascend."""

    def __init__(self):
        self.starts, self.ends = [], []

    def add(self, start: int, end: int) -> bool:
        """Whether [start, end) lay in none that was added before; it is added then."""
        at = bisect_right(self.starts, start)
        if at and self.ends[at - 1] >= end:
            return False
        low = bisect_left(self.starts, start)
        high = low
        while high < len(self.ends) and self.ends[high] <= end:
            high += 1
        self.starts[low:high], self.ends[low:high] = [start], [end]
        return True


def versioned(rule: Rule, match: re.Match) -> str:
    """The rule's label with the version that the match has."""
    if not (rule.pattern.count("(") > rule.pattern.count("(?") and match[1]):
        return rule.label
    version = match[1].replace(" ", ".")
    return f"{rule.label}-{version if '.' in version else version + '.0'}"


def scan(text: str | bytes | None) -> list[Detection]:
    """All detections of a text, as intervals [start, end) of its words, those suppressed marked.

    One that lies in a suppressed detection of a higher rank also lies in the one that suppressed that, so the
    intervals kept so far are all that has to be looked at.
    """
    raw = (text or b"") if isinstance(text, (bytes, type(None))) else text.encode()
    lowered = raw.translate(LOWER)
    if not (found := gated(lowered)):
        return []
    words = WORDS.findall(lowered.decode("utf-8", "replace"))
    joined = f" {' '.join(words)} "
    begins = list(accumulate((len(w) + 1 for w in words), initial=1))  # where each word starts in the joined words
    hits = []
    for rank, rule, pattern in found:
        for m in pattern.finditer(joined):
            first = bisect_left(begins, m.start())
            hits.append((rank, rule, versioned(rule, m), first, first + m.group().count(" ") + 1))
    hits.sort(key=lambda h: (-h[1].priority, h[3] - h[4], h[3], h[0]))
    cover = Cover()
    return [Detection(rule, label, rank, start, end, cover.add(start, end)) for rank, rule, label, start, end in hits]


def summary(hits: list[Detection]) -> tuple:
    """(n_base, first_word, last_word, base_labels, labels, score, n_detections) of a text's detections.

    Base detections count at all their places, suppressed or not; labels are those of kept detections
    and the base ones. The score is 1 - product of (1 - weight) over the labels' best weights.
    """
    base = [h for h in hits if h.rule.base]
    best: dict[str, float] = {}
    for h in hits:
        if h.kept or h.rule.base:
            best[h.label] = max(best.get(h.label, 0.0), h.rule.weight)
    clean = 1.0
    for w in sorted(best.values()):
        clean *= 1.0 - w
    starts = [h.start for h in base]
    labels = ",".join(sorted({h.rule.label for h in base}))
    return (len(base), min(starts, default=None), max(starts, default=None), labels, ",".join(sorted(best)), 1.0 - clean, sum(h.kept for h in hits))


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, n_detections long"


def _scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    none = summary([])
    for batch in batches:
        data, off = utf8_view(batch.column(1))
        counts = word_counts(data, off)
        raw = data.tobytes()
        rows = [none] * len(counts)
        for i in counts.nonzero()[0]:
            if hits := scan(raw[off[i] : off[i + 1]]):
                rows[i] = summary(hits)
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
        kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.float64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(counts, pa.int64()), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names)


def license_scan(docs: DataFrame) -> DataFrame:
    return arrow_map(docs.select("doc_id", "text"), _scan_batches, SCHEMA)


def op1_license_scan(spark, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))
