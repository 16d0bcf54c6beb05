"""Written license rules, by family.

Each line is a rule: words of a phrase (each an expression), the keyword that a text has to hold, label,
priority and weight. Words are what is between characters other than letters and digits, so ``GPL-2.0+``
is ``gpl 2 0`` and ``GPLv2`` is one word.
"""

# Phrases that name licenses, and their labels.
WRITTEN = r"""
# General public licenses
gplv1 | gplv1 | gpl-1.0 | 45 | 0.9
gplv2 | gplv2 | gpl-2.0 | 45 | 0.9
gplv3 | gplv3 | gpl-3.0 | 45 | 0.9
gnu gplv2 | gplv2 | gpl-2.0 | 46 | 0.95
gnu gplv3 | gplv3 | gpl-3.0 | 46 | 0.95
gplv2 only | gplv2 | gpl-2.0-only | 55 | 0.95
gplv3 only | gplv3 | gpl-3.0-only | 55 | 0.95
gplv2 or (?:later|newer|above) | gplv2 | gpl-2.0-or-later | 56 | 0.95
gplv3 or (?:later|newer|above) | gplv3 | gpl-3.0-or-later | 56 | 0.95
gplv2 or any later version | gplv2 | gpl-2.0-or-later | 57 | 0.95
gplv3 or any later version | gplv3 | gpl-3.0-or-later | 57 | 0.95
gplv2 or gplv3 | gplv3 | gpl-2.0 | 57 | 0.9
gpl 1 0 only | only | gpl-1.0-only | 60 | 1.0
gpl 1 0 or later | later | gpl-1.0-or-later | 60 | 1.0
gpl 2 0 only | only | gpl-2.0-only | 60 | 1.0
gpl 2 0 or later | later | gpl-2.0-or-later | 60 | 1.0
gpl 3 0 only | only | gpl-3.0-only | 60 | 1.0
gpl 3 0 or later | later | gpl-3.0-or-later | 60 | 1.0
gpl 2 only | only | gpl-2.0-only | 58 | 0.9
gpl 3 only | only | gpl-3.0-only | 58 | 0.9
gpl 2 or (?:later|newer) | gpl | gpl-2.0-or-later | 58 | 0.9
gpl 3 or (?:later|newer) | gpl | gpl-3.0-or-later | 58 | 0.9
gpl v2 only | v2 | gpl-2.0-only | 58 | 0.95
gpl v3 only | v3 | gpl-3.0-only | 58 | 0.95
gpl v2 or (?:later|newer) | v2 | gpl-2.0-or-later | 58 | 0.95
gpl v3 or (?:later|newer) | v3 | gpl-3.0-or-later | 58 | 0.95
gpl version 2 | version | gpl-2.0 | 50 | 0.9
gpl version 3 | version | gpl-3.0 | 50 | 0.9
gpl version 2 only | version | gpl-2.0-only | 58 | 0.95
gpl version 3 only | version | gpl-3.0-only | 58 | 0.95
gpl version 2 or (?:later|newer|above) | version | gpl-2.0-or-later | 58 | 0.95
gpl version 3 or (?:later|newer|above) | version | gpl-3.0-or-later | 58 | 0.95
gpl version 2 or any later version | later | gpl-2.0-or-later | 59 | 0.95
gpl version 3 or any later version | later | gpl-3.0-or-later | 59 | 0.95
general public licen[sc]e version 2 only | version | gpl-2.0-only | 61 | 0.97
general public licen[sc]e version 3 only | version | gpl-3.0-only | 61 | 0.97
general public licen[sc]e version 2 or (?:later|newer|above) | version | gpl-2.0-or-later | 61 | 0.97
general public licen[sc]e version 3 or (?:later|newer|above) | version | gpl-3.0-or-later | 61 | 0.97
general public licen[sc]e v2 | v2 | gpl-2.0 | 52 | 0.95
general public licen[sc]e v3 | v3 | gpl-3.0 | 52 | 0.95
general public licen[sc]e v2 or later | v2 | gpl-2.0-or-later | 61 | 0.97
general public licen[sc]e v3 or later | v3 | gpl-3.0-or-later | 61 | 0.97
version 2 or any later version | later | gpl-2.0-or-later | 35 | 0.7
version 3 or any later version | later | gpl-3.0-or-later | 35 | 0.7
version 2 of the licen[sc]e or at your option any later version | option | gpl-2.0-or-later | 65 | 0.9
version 3 of the licen[sc]e or at your option any later version | option | gpl-3.0-or-later | 65 | 0.9
version 2 1 of the licen[sc]e or at your option any later version | option | lgpl-2.1-or-later | 66 | 0.9
version 2 of the gnu general public licen[sc]e | version | gpl-2.0 | 62 | 0.97
version 3 of the gnu general public licen[sc]e | version | gpl-3.0 | 62 | 0.97
received a copy of the gnu general public licen[sc]e | received | gpl | 62 | 0.95
this program is free software you can redistribute it | redistribute | gpl | 40 | 0.7
this library is free software you can redistribute it | redistribute | lgpl | 40 | 0.7
gpl (?:linking|classpath|font) exception | exception | gpl-exception | 45 | 0.8
gpl 2 0 with classpath exception | classpath | gpl-2.0-classpath | 62 | 1.0
classpath exception 2 0 | classpath | gpl-2.0-classpath | 50 | 0.9
gnu classpath licen[sc]e | classpath | gpl-2.0-classpath | 50 | 0.9
gcc runtime library exception | runtime | gpl-3.0-gcc | 50 | 0.9
linux syscall note | syscall | gpl-2.0-syscall-note | 50 | 0.9
autoconf exception [23] 0 | autoconf | gpl-autoconf | 50 | 0.9
bison exception 2 2 | bison | gpl-bison | 50 | 0.9
openssl linking exception | linking | gpl-openssl | 50 | 0.8
licen[sc]e gpl | gpl | gpl | 38 | 0.85
# Lesser and library general public licenses
lgplv2 | lgplv2 | lgpl-2.0 | 45 | 0.9
lgplv2 1 | lgplv2 | lgpl-2.1 | 47 | 0.95
lgplv3 | lgplv3 | lgpl-3.0 | 45 | 0.9
gnu lgplv2 1 | lgplv2 | lgpl-2.1 | 48 | 0.95
gnu lgplv3 | lgplv3 | lgpl-3.0 | 46 | 0.95
lgplv2 or later | lgplv2 | lgpl-2.0-or-later | 56 | 0.95
lgplv2 1 or later | lgplv2 | lgpl-2.1-or-later | 57 | 0.95
lgplv2 1 only | lgplv2 | lgpl-2.1-only | 57 | 0.95
lgplv3 or later | lgplv3 | lgpl-3.0-or-later | 56 | 0.95
lgplv3 only | lgplv3 | lgpl-3.0-only | 56 | 0.95
lgpl 2 0 only | only | lgpl-2.0-only | 60 | 1.0
lgpl 2 0 or later | later | lgpl-2.0-or-later | 60 | 1.0
lgpl 2 1 only | only | lgpl-2.1-only | 60 | 1.0
lgpl 2 1 or later | later | lgpl-2.1-or-later | 60 | 1.0
lgpl 3 0 only | only | lgpl-3.0-only | 60 | 1.0
lgpl 3 0 or later | later | lgpl-3.0-or-later | 60 | 1.0
lgpl version 2 1 | version | lgpl-2.1 | 50 | 0.9
lgpl version 3 | version | lgpl-3.0 | 50 | 0.9
lgpl version 2 1 or later | version | lgpl-2.1-or-later | 58 | 0.95
lgpl version 3 or later | version | lgpl-3.0-or-later | 58 | 0.95
lgpl v2 1 or later | v2 | lgpl-2.1-or-later | 58 | 0.95
lgpl v3 or later | v3 | lgpl-3.0-or-later | 58 | 0.95
gnu lgpl | lgpl | lgpl | 42 | 0.9
(?:lesser|library) gpl | gpl | lgpl | 42 | 0.85
lesser general public licen[sc]e | lesser | lgpl | 45 | 0.9
library general public licen[sc]e | library | lgpl | 45 | 0.9
lesser general public licen[sc]e version 2 1 or later | lesser | lgpl-2.1-or-later | 63 | 0.97
lesser general public licen[sc]e version 3 or later | lesser | lgpl-3.0-or-later | 63 | 0.97
received a copy of the gnu lesser general public licen[sc]e | received | lgpl | 63 | 0.95
received a copy of the gnu library general public licen[sc]e | received | lgpl | 63 | 0.95
lgpl 3 0 linking exception | linking | lgpl-3.0-linking | 62 | 1.0
licen[sc]e lgpl | lgpl | lgpl | 38 | 0.85
# Affero general public licenses
agplv3 | agplv3 | agpl-3.0 | 45 | 0.9
gnu agplv3 | agplv3 | agpl-3.0 | 46 | 0.95
agplv3 only | agplv3 | agpl-3.0-only | 56 | 0.95
agplv3 or later | agplv3 | agpl-3.0-or-later | 56 | 0.95
agpl 1 0 only | only | agpl-1.0-only | 60 | 1.0
agpl 1 0 or later | later | agpl-1.0-or-later | 60 | 1.0
agpl 3 0 only | only | agpl-3.0-only | 60 | 1.0
agpl 3 0 or later | later | agpl-3.0-or-later | 60 | 1.0
agpl version 3 | version | agpl-3.0 | 50 | 0.9
agpl version 3 or later | version | agpl-3.0-or-later | 58 | 0.95
agpl v3 or later | v3 | agpl-3.0-or-later | 58 | 0.95
gnu agpl | agpl | agpl | 42 | 0.9
affero gpl | affero | agpl | 42 | 0.85
affero general public licen[sc]e | affero | agpl | 45 | 0.9
affero general public licen[sc]e version 3 or later | affero | agpl-3.0-or-later | 63 | 0.97
received a copy of the gnu affero general public licen[sc]e | received | agpl | 63 | 0.95
licen[sc]e agpl | agpl | agpl | 38 | 0.85
# Documentation licenses
gnu fdl | fdl | gfdl | 42 | 0.9
gfdl 1 [123] | gfdl | gfdl | 45 | 0.9
gfdl 1 2 or later | gfdl | gfdl-1.2-or-later | 60 | 1.0
gfdl 1 3 or later | gfdl | gfdl-1.3-or-later | 60 | 1.0
gfdl 1 3 only | gfdl | gfdl-1.3-only | 60 | 1.0
free documentation licen[sc]e | documentation | gfdl | 42 | 0.9
with no invariant sections | invariant | gfdl | 40 | 0.8
open publication licen[sc]e | publication | opl | 42 | 0.85
lppl 1 3[ac] | lppl | lppl-1.3 | 50 | 0.95
latex project public licen[sc]e | latex | lppl | 45 | 0.95
# Two, three and four clauses
0bsd | 0bsd | 0bsd | 45 | 0.95
bsd 0 clause | clause | 0bsd | 50 | 0.95
bsd zero clause | clause | 0bsd | 50 | 0.95
zero clause bsd | clause | 0bsd | 50 | 0.95
bsd 1 clause | clause | bsd-1-clause | 50 | 0.95
bsd 2 clause | clause | bsd-2-clause | 50 | 0.95
bsd 3 clause | clause | bsd-3-clause | 50 | 0.95
bsd 4 clause | clause | bsd-4-clause | 50 | 0.95
(?:2|two) clause bsd | clause | bsd-2-clause | 50 | 0.95
(?:3|three) clause bsd | clause | bsd-3-clause | 50 | 0.95
(?:4|four) clause bsd | clause | bsd-4-clause | 50 | 0.95
(?:simplified|freebsd) bsd licen[sc]e | bsd | bsd-2-clause | 52 | 0.95
(?:new|revised|modified) bsd licen[sc]e | bsd | bsd-3-clause | 52 | 0.95
(?:original|old) bsd licen[sc]e | bsd | bsd-4-clause | 52 | 0.95
(?:new|revised|modified) bsd | bsd | bsd-3-clause | 42 | 0.85
freebsd licen[sc]e | freebsd | bsd-2-clause | 42 | 0.9
netbsd licen[sc]e | netbsd | bsd-2-clause | 42 | 0.9
openbsd licen[sc]e | openbsd | isc | 42 | 0.8
bsd (?:style|like) licen[sc]e | bsd | bsd | 40 | 0.85
bsd licen[sc]ed | bsd | bsd | 38 | 0.85
bsd 2 clause patent | patent | bsd-2-clause-patent | 58 | 1.0
bsd 3 clause clear | clear | bsd-3-clause-clear | 58 | 1.0
bsd 3 clause attribution | attribution | bsd-3-clause-attribution | 58 | 1.0
bsd 3 clause lbnl | lbnl | bsd-3-clause-lbnl | 58 | 1.0
bsd 3 clause no nuclear licen[sc]e | nuclear | bsd-3-clause-no-nuclear | 58 | 1.0
bsd 4 clause uc | uc | bsd-4-clause-uc | 58 | 1.0
bsd source code attribution | attribution | bsd-source-code | 50 | 0.95
governed by a bsd style licen[sc]e | governed | bsd | 55 | 0.95
redistributions of source code must retain the above copyright notice | redistributions | bsd | 55 | 0.9
redistributions in binary form must reproduce the above copyright notice | redistributions | bsd | 55 | 0.9
neither the name of the copyright holder nor the names of its contributors | neither | bsd-3-clause | 58 | 0.95
neither the name of the author nor the names of contributors | neither | bsd-3-clause | 58 | 0.9
all advertising materials mentioning features or use of this software | advertising | bsd-4-clause | 58 | 0.95
provided by the copyright holders and contributors as is | contributors | bsd | 50 | 0.8
licen[sc]e bsd | bsd | bsd | 38 | 0.85
# Short permissive licenses
licen[sc]e mit | mit | mit | 38 | 0.9
mit licen[sc]ed | mit | mit | 38 | 0.9
mit (?:style|like) licen[sc]e | mit | mit | 40 | 0.8
mit 0 | mit | mit-0 | 45 | 0.9
mit no attribution | attribution | mit-0 | 48 | 0.95
mit x11 licen[sc]e | x11 | mit | 45 | 0.9
mit expat licen[sc]e | expat | mit | 45 | 0.9
mit cmu | cmu | mit-cmu | 45 | 0.95
mit feh | feh | mit-feh | 45 | 0.95
mit modern variant | variant | mit-modern | 45 | 0.95
mit or apache 2 0 | mit | mit-or-apache-2.0 | 58 | 0.97
apache 2 0 or mit | mit | mit-or-apache-2.0 | 58 | 0.97
permission is hereby granted free of charge to any person obtaining a copy | obtaining | mit | 65 | 0.98
above copyright notice and this permission notice shall be included in all copies | notice | mit | 60 | 0.9
sublicen[sc]e and or sell copies of the software | sell | mit | 50 | 0.8
licen[sc]e isc | isc | isc | 38 | 0.9
isc licen[sc]ed | isc | isc | 38 | 0.9
permission to use copy modify and or distribute this software for any purpose | distribute | isc | 65 | 0.97
permission to use copy modify and distribute this software for any purpose | distribute | isc | 65 | 0.95
with or without fee is hereby granted | hereby | isc | 45 | 0.7
permission to use copy modify and distribute this software and its documentation | documentation | hpnd | 60 | 0.9
permission to use copy modify distribute and sell this software | sell | hpnd-sell | 60 | 0.9
altered source versions must be plainly marked as such | altered | zlib | 55 | 0.9
zlib libpng licen[sc]e | libpng | zlib | 45 | 0.95
zlib acknowledgement | acknowledgement | zlib-acknowledgement | 48 | 0.95
licen[sc]e zlib | zlib | zlib | 38 | 0.9
boost software licen[sc]e version 1 0 | boost | boost-1.0 | 55 | 0.97
bsl 1 0 | bsl | boost-1.0 | 45 | 0.8
boost org license 1 0 txt | boost | boost-1.0 | 55 | 0.95
university of illinois open source licen[sc]e | illinois | ncsa | 45 | 0.95
ncsa open source licen[sc]e | ncsa | ncsa | 45 | 0.95
fair licen[sc]e | fair | fair | 40 | 0.8
blue oak model licen[sc]e | oak | blueoak-1.0.0 | 45 | 0.95
blueoak 1 0 0 | blueoak | blueoak-1.0.0 | 50 | 1.0
universal permissive licen[sc]e | permissive | upl-1.0 | 45 | 0.95
upl 1 0 | upl | upl-1.0 | 45 | 0.95
beer ware licen[sc]e | beer | beerware | 40 | 0.9
beerware | beerware | beerware | 38 | 0.85
buy me a beer in return | beer | beerware | 45 | 0.9
do what the fuck you want to public licen[sc]e | fuck | wtfpl | 55 | 0.98
wtfpl version 2 | wtfpl | wtfpl | 45 | 0.95
software shall be used for good not evil | evil | json | 55 | 0.98
json licen[sc]e | json | json | 40 | 0.85
# Apache licenses
apache 2 | apache | apache-2.0 | 39 | 0.8
apache2 | apache2 | apache-2.0 | 38 | 0.7
apachev2 | apachev2 | apache-2.0 | 42 | 0.9
apache licen[sc]e 2 0 | apache | apache-2.0 | 50 | 0.95
apache licen[sc]e v2 0 | apache | apache-2.0 | 50 | 0.95
apache licen[sc]e v2 | apache | apache-2.0 | 48 | 0.95
apache licen[sc]e 1 1 | apache | apache-1.1 | 50 | 0.95
asl 2 0 | asl | apache-2.0 | 42 | 0.8
apache 2 0 with llvm exception | llvm | apache-2.0-llvm | 62 | 1.0
apache org licenses license 2 0 | apache | apache-2.0 | 60 | 0.97
licen[sc]ed to the apache software foundation | foundation | apache-2.0 | 50 | 0.8
may not use this file except in compliance with the licen[sc]e | compliance | apache-2.0 | 60 | 0.9
unless required by applicable law or agreed to in writing software | applicable | apache-2.0 | 50 | 0.7
as is basis without warranties or conditions of any kind | basis | apache-2.0 | 50 | 0.7
licen[sc]e apache | apache | apache | 38 | 0.85
# File-scoped copyleft
mpl 1 0 | mpl | mpl-1.0 | 45 | 0.95
mpl 1 1 | mpl | mpl-1.1 | 45 | 0.95
mpl 2 0 | mpl | mpl-2.0 | 45 | 0.95
mplv2 0 | mplv2 | mpl-2.0 | 45 | 0.9
mplv2 | mplv2 | mpl-2.0 | 44 | 0.9
mpl 2 0 no copyleft exception | copyleft | mpl-2.0-no-copyleft | 60 | 1.0
subject to the terms of the mozilla public licen[sc]e | mozilla | mpl | 62 | 0.97
mozilla public licen[sc]e v 2 0 | mozilla | mpl-2.0 | 62 | 0.97
mozilla org mpl 2 0 | mozilla | mpl-2.0 | 55 | 0.95
npl 1 [01] | npl | npl | 45 | 0.9
netscape public licen[sc]e | netscape | npl | 45 | 0.95
epl 1 0 | epl | epl-1.0 | 45 | 0.95
epl 2 0 | epl | epl-2.0 | 45 | 0.95
eplv2 | eplv2 | epl-2.0 | 45 | 0.9
edl 1 0 | edl | edl-1.0 | 45 | 0.9
cpl 1 0 | cpl | cpl-1.0 | 45 | 0.9
ipl 1 0 | ipl | ipl-1.0 | 45 | 0.9
cddl 1 0 | cddl | cddl-1.0 | 45 | 0.95
cddl 1 1 | cddl | cddl-1.1 | 45 | 0.95
common development and distribution licen[sc]e | development | cddl | 42 | 0.95
eupl 1 1 | eupl | eupl-1.1 | 45 | 0.95
eupl 1 2 | eupl | eupl-1.2 | 45 | 0.95
eupl 1 2 or later | eupl | eupl-1.2-or-later | 58 | 1.0
ms pl | pl | ms-pl | 38 | 0.7
ms rl | rl | ms-rl | 38 | 0.7
osl 3 0 | osl | osl-3.0 | 45 | 0.95
afl 2 1 | afl | afl-2.1 | 45 | 0.9
afl 3 0 | afl | afl-3.0 | 45 | 0.9
qpl 1 0 | qpl | qpl-1.0 | 45 | 0.95
apsl 2 0 | apsl | apsl-2.0 | 45 | 0.95
apple public source licen[sc]e | apple | apsl | 45 | 0.95
sun public licen[sc]e | sun | spl | 45 | 0.9
sun industry standards source licen[sc]e | industry | sissl | 45 | 0.95
lucent public licen[sc]e | lucent | lpl | 45 | 0.95
nokia open source licen[sc]e | nokia | nokia | 45 | 0.95
realnetworks public source licen[sc]e | realnetworks | rpsl | 45 | 0.95
reciprocal public licen[sc]e | reciprocal | rpl | 45 | 0.95
sybase open watcom public licen[sc]e | sybase | watcom | 45 | 0.95
nasa open source agreement | nasa | nasa | 45 | 0.95
cecill (?:a|b|c) | cecill | cecill | 42 | 0.9
cecill 2 [01] | cecill | cecill-2 | 45 | 0.95
cecill licen[sc]e | cecill | cecill | 42 | 0.95
mulan psl v2 | mulan | mulanpsl-2.0 | 50 | 0.95
mulan permissive software licen[sc]e | mulan | mulanpsl | 45 | 0.95
mulanpsl 2 0 | mulanpsl | mulanpsl-2.0 | 50 | 1.0
eclipse org legal epl v10 | eclipse | epl-1.0 | 55 | 0.95
eclipse org legal epl 2 0 | eclipse | epl-2.0 | 55 | 0.95
# Languages, libraries and projects
psf 2 0 | psf | python-2.0 | 42 | 0.9
python 2 0 licen[sc]e | python | python-2.0 | 45 | 0.95
cnri python licen[sc]e | cnri | python-cnri | 45 | 0.95
zope public licen[sc]e | zope | zpl | 45 | 0.95
zpl 2 [01] | zpl | zpl-2 | 45 | 0.95
same terms as perl itself | perl | perl | 50 | 0.95
same licen[sc]e as perl | perl | perl | 48 | 0.9
same terms as ruby | ruby | ruby | 48 | 0.9
artistic licen[sc]e 2 0 | artistic | artistic-2.0 | 50 | 0.95
clarified artistic licen[sc]e | clarified | artistic-clarified | 50 | 0.95
openldap public licen[sc]e | openldap | oldap | 45 | 0.95
sleepycat licen[sc]e | sleepycat | sleepycat | 45 | 0.95
freetype licen[sc]e | freetype | freetype | 42 | 0.9
freetype project licen[sc]e | freetype | freetype | 45 | 0.95
independent jpeg group | jpeg | ijg | 40 | 0.8
libtiff licen[sc]e | libtiff | libtiff | 42 | 0.95
imagemagick licen[sc]e | imagemagick | imagemagick | 42 | 0.95
info zip licen[sc]e | zip | info-zip | 42 | 0.95
ntp licen[sc]e | ntp | ntp | 40 | 0.85
net snmp licen[sc]e | snmp | net-snmp | 42 | 0.95
wxwindows library licen[sc]e | wxwindows | wxwindows | 45 | 0.95
w3c software (?:notice|licen[sc]e) | w3c | w3c | 45 | 0.95
w3c document licen[sc]e | w3c | w3c-document | 45 | 0.95
unicode licen[sc]e agreement | unicode | unicode | 45 | 0.9
unicode dfs 201[56] | unicode | unicode-dfs | 50 | 1.0
icu licen[sc]e | icu | icu | 40 | 0.9
intel open source licen[sc]e | intel | intel | 45 | 0.95
eiffel forum licen[sc]e | eiffel | efl | 45 | 0.95
xnet licen[sc]e | xnet | xnet | 42 | 0.95
vovida software licen[sc]e | vovida | vsl | 45 | 0.95
jasper licen[sc]e | jasper | jasper | 42 | 0.85
# Fonts and data
sil ofl | ofl | ofl | 42 | 0.9
ofl 1 0 | ofl | ofl-1.0 | 45 | 0.95
ofl 1 1 | ofl | ofl-1.1 | 45 | 0.95
open font licen[sc]e | font | ofl | 42 | 0.9
scripts sil org ofl | sil | ofl | 50 | 0.9
bitstream vera licen[sc]e | vera | bitstream-vera | 45 | 0.95
odbl 1 0 | odbl | odbl-1.0 | 45 | 0.95
odc by 1 0 | odc | odc-by-1.0 | 48 | 0.95
odc pddl | pddl | pddl | 42 | 0.9
pddl 1 0 | pddl | pddl-1.0 | 45 | 0.95
public domain dedication and licen[sc]e | dedication | pddl | 45 | 0.9
open data commons open database licen[sc]e | commons | odbl | 55 | 0.97
cdla permissive 1 0 | cdla | cdla-permissive-1.0 | 50 | 1.0
cdla permissive 2 0 | cdla | cdla-permissive-2.0 | 50 | 1.0
cdla sharing 1 0 | cdla | cdla-sharing-1.0 | 50 | 1.0
community data licen[sc]e agreement | community | cdla | 45 | 0.95
open government licen[sc]e | government | ogl | 42 | 0.9
ogl uk 3 0 | ogl | ogl-uk-3.0 | 50 | 1.0
licence ouverte | ouverte | etalab | 42 | 0.9
etalab 2 0 | etalab | etalab-2.0 | 48 | 0.95
datenlizenz deutschland | datenlizenz | dl-de | 42 | 0.9
dl de by 2 0 | dl | dl-de-by-2.0 | 50 | 1.0
# Creative commons
cc0 | cc0 | cc0 | 38 | 0.85
cc0 1 0 universal | cc0 | cc0-1.0 | 52 | 0.97
creative commons zero | zero | cc0 | 45 | 0.95
creative commons cc0 | cc0 | cc0 | 45 | 0.95
creativecommons org publicdomain zero 1 0 | creativecommons | cc0-1.0 | 60 | 0.98
creativecommons org publicdomain mark 1 0 | creativecommons | public-domain | 60 | 0.95
public domain mark | mark | public-domain | 42 | 0.85
creative commons licen[sc]e | creative | cc | 35 | 0.8
creative commons attribution 4 0 international | creative | cc-by-4.0 | 55 | 0.97
creative commons attribution 3 0 unported | creative | cc-by-3.0 | 55 | 0.97
creative commons attribution sharealike 4 0 international | sharealike | cc-by-sa-4.0 | 58 | 0.97
creative commons attribution sharealike 3 0 unported | sharealike | cc-by-sa-3.0 | 58 | 0.97
creative commons attribution noncommercial 4 0 international | noncommercial | cc-by-nc-4.0 | 58 | 0.97
attribution noncommercial sharealike | sharealike | cc-by-nc-sa | 45 | 0.9
attribution noncommercial noderivatives | noderivatives | cc-by-nc-nd | 45 | 0.9
attribution non commercial share alike | alike | cc-by-nc-sa | 45 | 0.9
attribution share alike | alike | cc-by-sa | 42 | 0.85
creativecommons org licenses by 4 0 | creativecommons | cc-by-4.0 | 60 | 0.98
creativecommons org licenses by 3 0 | creativecommons | cc-by-3.0 | 60 | 0.98
creativecommons org licenses by sa 4 0 | creativecommons | cc-by-sa-4.0 | 60 | 0.98
creativecommons org licenses by sa 3 0 | creativecommons | cc-by-sa-3.0 | 60 | 0.98
creativecommons org licenses by nc 4 0 | creativecommons | cc-by-nc-4.0 | 60 | 0.98
creativecommons org licenses by nd 4 0 | creativecommons | cc-by-nd-4.0 | 60 | 0.98
creativecommons org licenses by nc sa 4 0 | creativecommons | cc-by-nc-sa-4.0 | 60 | 0.98
creativecommons org licenses by nc nd 4 0 | creativecommons | cc-by-nc-nd-4.0 | 60 | 0.98
# Source available, model and business licenses
busl 1 1 | busl | bsl-1.1 | 48 | 0.95
sspl 1 0 | sspl | sspl-1.0 | 48 | 0.95
sspl v1 | sspl | sspl-1.0 | 48 | 0.9
elastic licen[sc]e 2 0 | elastic | elastic-2.0 | 52 | 0.97
commons clause | clause | commons-clause | 40 | 0.85
polyform noncommercial | polyform | polyform-noncommercial | 45 | 0.95
polyform small business | polyform | polyform-small-business | 45 | 0.95
polyform (?:shield|perimeter|strict) | polyform | polyform | 45 | 0.95
parity public licen[sc]e | parity | parity | 45 | 0.95
prosperity public licen[sc]e | prosperity | prosperity | 45 | 0.95
hippocratic licen[sc]e | hippocratic | hippocratic | 45 | 0.95
functional source licen[sc]e | functional | fsl | 45 | 0.95
confluent community licen[sc]e | confluent | confluent | 45 | 0.95
timescale licen[sc]e | timescale | timescale | 42 | 0.95
redis source available licen[sc]e | redis | rsal | 45 | 0.95
openrail | openrail | openrail | 42 | 0.85
creativeml open rail m | creativeml | openrail | 48 | 0.95
creativeml openrail m | creativeml | openrail | 48 | 0.95
llama [23] community licen[sc]e | llama | llama | 48 | 0.95
gemma terms of use | gemma | gemma | 45 | 0.9
# Grants, limits and disclaimers
in no event shall the authors or copyright holders be liable | liable | warranty | 45 | 0.5
in no event shall the copyright (?:owner|holder|holders) or contributors be liable | liable | warranty | 45 | 0.5
implied warranty of merchantability or fitness for a particular purpose | merchantability | warranty | 45 | 0.5
provided as is without warranty of any kind | provided | warranty | 42 | 0.5
provided as is and without any express or implied warranties | provided | warranty | 45 | 0.5
perpetual worldwide non exclusive no charge royalty free irrevocable | royalty | grant | 45 | 0.5
royalty free licen[sc]e | royalty | grant | 30 | 0.4
free for (?:personal|private) use | free | noncommercial | 30 | 0.5
free for non commercial use | commercial | noncommercial | 32 | 0.6
for non commercial purposes only | commercial | noncommercial | 32 | 0.6
for (?:research|academic|evaluation) purposes only | purposes | research-only | 32 | 0.6
not for redistribution | redistribution | proprietary | 30 | 0.5
do not distribute | distribute | proprietary | 25 | 0.4
do not redistribute | redistribute | proprietary | 25 | 0.4
unpublished proprietary (?:source|information) | unpublished | proprietary | 40 | 0.8
trade secrets? of | trade | proprietary | 25 | 0.4
dedicated to the public domain | dedicated | public-domain | 42 | 0.9
released into the public domain | released | public-domain | 42 | 0.9
waives? all copyright | copyright | public-domain | 30 | 0.5
copyleft | copyleft | copyleft | 20 | 0.4
dual licen[sc]ed under the mit and gpl licenses | dual | mit-and-gpl | 58 | 0.95
see the licen[sc]e file for (?:details|terms) | file | see-license | 30 | 0.2
proprietary licen[sc]e | proprietary | proprietary | 35 | 0.8
commercial licen[sc]e | commercial | commercial | 30 | 0.6
"""
