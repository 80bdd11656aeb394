"""The signature rules of the license scan, in order of priority: the first of equal spans wins.

A line is: label | score | keyword | expression. Expressions run over lower-cased words with one space between them
(punctuation is gone: GPL-3.0 is `gpl 3 0`), from a word's start to a word's end. The keyword is a plain string that
every match of the expression contains; a rule runs only on texts that hold it.
"""

SIGNATURES = """
# identifiers in file headers
mit | 1.0 | spdx license identifier | spdx license identifier mit
mit-0 | 1.0 | spdx license identifier | spdx license identifier mit 0
apache-2 | 1.0 | spdx license identifier | spdx license identifier apache 2 0(?: with llvm exception)?
apache-1.1 | 1.0 | spdx license identifier | spdx license identifier apache 1 1
bsd-2-clause | 1.0 | spdx license identifier | spdx license identifier bsd 2 clause(?: patent| views)?
bsd-3-clause | 1.0 | spdx license identifier | spdx license identifier bsd 3 clause(?: clear| lbnl| attribution)?
bsd-4-clause | 1.0 | spdx license identifier | spdx license identifier bsd 4 clause(?: uc)?
0bsd | 1.0 | spdx license identifier | spdx license identifier 0bsd
gpl-1 | 1.0 | spdx license identifier | spdx license identifier gpl 1 0(?: only| or later)?
gpl-2 | 1.0 | spdx license identifier | spdx license identifier gpl 2 0(?: only| or later)?(?: with [a-z0-9 ]{1,40} exception(?: [0-9](?: [0-9])?)?)?
gpl-3 | 1.0 | spdx license identifier | spdx license identifier gpl 3 0(?: only| or later)?(?: with [a-z0-9 ]{1,40} exception(?: [0-9](?: [0-9])?)?)?
lgpl-2 | 1.0 | spdx license identifier | spdx license identifier lgpl 2 0(?: only| or later)?
lgpl-2.1 | 1.0 | spdx license identifier | spdx license identifier lgpl 2 1(?: only| or later)?
lgpl-3 | 1.0 | spdx license identifier | spdx license identifier lgpl 3 0(?: only| or later)?
agpl-3 | 1.0 | spdx license identifier | spdx license identifier agpl 3 0(?: only| or later)?
gfdl-1.3 | 1.0 | spdx license identifier | spdx license identifier gfdl 1 3(?: only| or later)?
mpl-1.1 | 1.0 | spdx license identifier | spdx license identifier mpl 1 1
mpl-2 | 1.0 | spdx license identifier | spdx license identifier mpl 2 0(?: no copyleft exception)?
epl-1 | 1.0 | spdx license identifier | spdx license identifier epl 1 0
epl-2 | 1.0 | spdx license identifier | spdx license identifier epl 2 0
cddl-1 | 1.0 | spdx license identifier | spdx license identifier cddl 1 [01]
eupl-1.2 | 1.0 | spdx license identifier | spdx license identifier eupl 1 2
boost-1 | 1.0 | spdx license identifier | spdx license identifier bsl 1 0
zlib | 1.0 | spdx license identifier | spdx license identifier zlib
isc | 1.0 | spdx license identifier | spdx license identifier isc
unlicense | 1.0 | spdx license identifier | spdx license identifier unlicense
wtfpl | 1.0 | spdx license identifier | spdx license identifier wtfpl
artistic-2 | 1.0 | spdx license identifier | spdx license identifier artistic 2 0
ofl-1.1 | 1.0 | spdx license identifier | spdx license identifier ofl 1 1(?: rfn| no rfn)?
python-2 | 1.0 | spdx license identifier | spdx license identifier (?:psf|python) 2 0
postgresql | 1.0 | spdx license identifier | spdx license identifier postgresql
ms-pl | 1.0 | spdx license identifier | spdx license identifier ms pl
odbl-1 | 1.0 | spdx license identifier | spdx license identifier odbl 1 0
cc0-1 | 1.0 | spdx license identifier | spdx license identifier cc0 1 0
cc-by-nc-sa | 1.0 | spdx license identifier | spdx license identifier cc by nc sa [1-4] [0-9]
cc-by-nc-nd | 1.0 | spdx license identifier | spdx license identifier cc by nc nd [1-4] [0-9]
cc-by-nc | 1.0 | spdx license identifier | spdx license identifier cc by nc [1-4] [0-9]
cc-by-sa | 1.0 | spdx license identifier | spdx license identifier cc by sa [1-4] [0-9]
cc-by-nd | 1.0 | spdx license identifier | spdx license identifier cc by nd [1-4] [0-9]
cc-by | 1.0 | spdx license identifier | spdx license identifier cc by [1-4] [0-9]
# mit
mit | 0.95 | mit license | (?:is |are )?(?:dual )?licen[cs]ed under (?:the terms of )?(?:the )?(?:expat )?mit license
mit | 0.9 | mit license | (?:released|distributed|published|available|provided|shared) under (?:the terms (?:and conditions )?of )?(?:the )?mit license
mit | 0.9 | mit license | (?:covered|governed) by (?:the terms of )?(?:the )?mit license
mit | 0.85 | mit license | (?:subject to|in accordance with|according to) (?:the terms of )?(?:the )?mit license
mit | 0.8 | mit license | (?:see|read|consult) the mit license
mit | 0.9 | mit licence | (?:licen[cs]ed |released |distributed )?under (?:the terms of )?(?:the )?mit licence
mit | 0.85 | mit licensed | (?:is |are )?mit licensed
mit | 0.8 | licensed mit | licensed mit
mit | 0.85 | license mit | license mit
mit | 0.85 | licensed under mit | licensed under mit
mit | 0.7 | mit license | (?:the )?(?:expat )?mit license
mit | 0.85 | opensource org licenses mit | opensource org licenses mit(?: license)?(?: php| html)?
mit | 0.95 | permission is hereby granted free of charge to any person obtaining a copy of this software | permission is hereby granted free of charge to any person obtaining a copy of this software(?: and associated documentation files)?
mit | 0.75 | permission is hereby granted free of charge | permission is hereby granted free of charge
mit | 0.8 | to use copy modify merge publish distribute sublicense | (?:including without limitation the rights )?to use copy modify merge publish distribute sublicense(?: and or sell)?(?: copies of the software)?
mit | 0.7 | the above copyright notice and this permission notice shall be included | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit-0 | 0.9 | mit no attribution | mit no attribution(?: license)?
# isc, zlib and other short permissive ones
isc | 0.95 | isc license | (?:licen[cs]ed |released |distributed |available )?under (?:the terms of )?(?:the )?isc license
isc | 0.75 | isc license | (?:the )?isc license
isc | 0.85 | isc licensed | isc licensed
isc | 0.85 | permission to use copy modify and or distribute this software | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
0bsd | 0.85 | zero clause bsd | (?:the )?zero clause bsd(?: license)?
0bsd | 0.85 | 0bsd | (?:licensed under )?(?:the )?0bsd(?: license)?
zlib | 0.9 | zlib license | (?:licen[cs]ed |released |distributed |available )?under (?:the terms of )?(?:the )?zlib license
zlib | 0.85 | zlib libpng | (?:the )?zlib libpng license
zlib | 0.75 | zlib license | (?:the )?zlib license
zlib | 0.85 | provided as is without any express or implied warranty | this software is provided as is without any express or implied warranty(?: in no event will the authors be held liable)?
libpng | 0.85 | libpng license | (?:the )?libpng license(?: version 2)?
boost-1 | 0.95 | boost software license | (?:distributed |licen[cs]ed |released )?under (?:the )?boost software license(?: version)?(?: 1 0)?
boost-1 | 0.8 | boost software license | (?:the )?boost software license(?: version)?(?: 1 0)?
boost-1 | 0.85 | boost org license 1 0 | boost org license 1 0(?: txt)?
unlicense | 0.85 | unlicense | (?:licen[cs]ed |released |distributed )?under (?:the )?unlicense
unlicense | 0.85 | free and unencumbered software released into the public domain | this is free and unencumbered software released into the public domain
unlicense | 0.8 | unlicense org | unlicense org
wtfpl | 0.9 | wtfpl | (?:licen[cs]ed |released |distributed )?(?:under )?(?:the )?wtfpl(?: version 2| v2)?
wtfpl | 0.9 | public license | do what the f[a-z]{2,5} you want to public license
beerware | 0.85 | beer ware license | (?:the )?beer ware license(?: revision 42)?
fair | 0.7 | fair license | (?:the )?fair license
ncsa | 0.85 | ncsa open source license | (?:university of illinois )?(?:uiuc )?ncsa open source license
x11 | 0.8 | x11 license | (?:the )?x11 license
hpnd | 0.75 | permission to use copy modify and distribute this software and its documentation | permission to use copy modify and distribute this software and its documentation for any purpose
curl | 0.8 | curl license | (?:the )?curl license
upl-1 | 0.9 | universal permissive license | universal permissive license(?: upl)?(?: version| v)? ?1(?: 0)?
afl-3 | 0.85 | academic free license | academic free license(?: version| v)?(?: ?3(?: 0)?)?
python-2 | 0.85 | python software foundation license | (?:the )?python software foundation license(?: version| v)?(?: ?2)?
python-2 | 0.85 | psf license | psf license(?: agreement)?(?: version 2)?
php-3.01 | 0.85 | php license | (?:the )?php license(?: version| v)?(?: ?3 0(?:1)?)?
ruby | 0.75 | ruby license | (?:the )?ruby license
postgresql | 0.85 | postgresql license | (?:the )?postgresql license
openssl | 0.85 | openssl license | (?:the )?(?:dual )?openssl license
openssl | 0.8 | openssl toolkit | this product includes software developed by the openssl project for use in the openssl toolkit
vim | 0.75 | vim license | (?:the )?vim license
icu | 0.8 | icu license | (?:the )?icu license
unicode | 0.8 | unicode license | (?:the )?unicode license(?: agreement)?(?: v3)?
ms-pl | 0.9 | microsoft public license | (?:the )?microsoft public license(?: ms pl)?
ms-rl | 0.9 | microsoft reciprocal license | (?:the )?microsoft reciprocal license(?: ms rl)?
blueoak-1 | 0.9 | blue oak model license | (?:the )?blue oak model license(?: 1 0 0)?
bsl-1.1 | 0.9 | business source license | (?:the )?business source license(?: version)?(?: 1 1)?
sspl-1 | 0.9 | server side public license | (?:the )?server side public license(?: sspl)?(?: version| v)?(?: ?1)?
elastic-2 | 0.9 | elastic license | (?:the )?elastic license(?: version)?(?: 2(?: 0)?)?
commons-clause | 0.85 | commons clause | (?:the )?commons clause(?: license)?(?: condition)?
# apache
apache-2 | 0.98 | licensed under the apache license version 2 | licensed under the apache license version 2(?: 0)?(?: the license)?
apache-2 | 0.95 | apache license version 2 | (?:the )?apache license version 2(?: 0)?(?: january 2004)?
apache-2 | 0.95 | apache license 2 | (?:(?:licen[cs]ed|released|distributed|available) under )?(?:the )?apache license 2(?: 0)?
apache-2 | 0.9 | apache 2 0 license | (?:(?:licen[cs]ed|released|distributed|available) under )?(?:the )?apache 2 0 license
apache-2 | 0.9 | apache 2 license | (?:(?:licen[cs]ed|released|distributed|available) under )?(?:the )?apache 2 license
apache-2 | 0.9 | apache software license | (?:the )?apache software license(?: version| v)? ?2(?: 0)?
apache-2 | 0.85 | apache licensed | apache licensed
apache-2 | 0.85 | apache 2 0 licensed | apache 2 0 licensed
apache-2 | 0.85 | apache license v2 | (?:the )?apache license v2(?: 0)?
apache-2 | 0.85 | licensed under apache 2 | licensed under apache 2(?: 0)?
apache-2 | 0.8 | license apache 2 | license apache 2(?: 0)?
apache-2 | 0.8 | asl 2 0 | asl 2 0
apache-2 | 0.85 | apache org licenses license 2 0 | (?:www )?apache org licenses license 2 0(?: txt| html)?
apache-2 | 0.8 | you may not use this file except in compliance with the license | you may not use this file except in compliance with the license(?: you may obtain a copy of the license at)?
apache-2 | 0.75 | distributed on an as is basis without warranties or conditions of any kind | distributed on an as is basis without warranties or conditions of any kind(?: either express or implied)?
apache-1.1 | 0.9 | apache software license version 1 1 | (?:the )?apache software license version 1 1
apache-1.1 | 0.85 | apache license version 1 1 | (?:the )?apache license version 1 1
apache-1 | 0.85 | apache license version 1 0 | (?:the )?apache license version 1 0
apache | 0.5 | apache license | (?:the )?apache license
# bsd
bsd-3-clause | 0.95 | bsd 3 clause | (?:(?:licen[cs]ed|released|distributed|available) under )?(?:the )?bsd 3 clause(?: license)?
bsd-3-clause | 0.95 | 3 clause bsd | (?:(?:licen[cs]ed|released|distributed|available) under )?(?:the )?3 clause bsd(?: license)?
bsd-3-clause | 0.95 | three clause bsd | (?:(?:licen[cs]ed|released|distributed|available) under )?(?:the )?three clause bsd(?: license)?
bsd-3-clause | 0.9 | new bsd | (?:the )?new bsd(?: license)
bsd-3-clause | 0.9 | modified bsd | (?:the )?modified bsd(?: license)
bsd-3-clause | 0.9 | revised bsd | (?:the )?revised bsd(?: license)
bsd-2-clause | 0.95 | bsd 2 clause | (?:(?:licen[cs]ed|released|distributed|available) under )?(?:the )?bsd 2 clause(?: license)?
bsd-2-clause | 0.95 | 2 clause bsd | (?:(?:licen[cs]ed|released|distributed|available) under )?(?:the )?2 clause bsd(?: license)?
bsd-2-clause | 0.95 | two clause bsd | (?:(?:licen[cs]ed|released|distributed|available) under )?(?:the )?two clause bsd(?: license)?
bsd-2-clause | 0.9 | simplified bsd | (?:the )?simplified bsd(?: license)
bsd-2-clause | 0.9 | freebsd license | (?:the )?freebsd license
bsd-4-clause | 0.95 | bsd 4 clause | (?:the )?bsd 4 clause(?: license)?
bsd-4-clause | 0.95 | 4 clause bsd | (?:the )?4 clause bsd(?: license)?
bsd-4-clause | 0.9 | original bsd | (?:the )?original bsd license
bsd-4-clause | 0.85 | all advertising materials mentioning features | all advertising materials mentioning features or use of this software must display
bsd-3-clause | 0.9 | may be used to endorse or promote products | (?:neither the names? of )[a-z0-9 ]{1,120}may be used to endorse or promote products(?: derived from this software)?
bsd | 0.9 | redistribution and use in source and binary forms | redistribution and use in source and binary forms with or without modification are permitted(?: provided that the following conditions are met)?
bsd | 0.75 | redistribution and use in source and binary forms | redistribution and use in source and binary forms
bsd | 0.6 | redistributions of source code must retain the above copyright | redistributions of source code must retain the above copyright notice
bsd | 0.6 | redistributions in binary form must reproduce the above copyright | redistributions in binary form must reproduce the above copyright notice
bsd | 0.85 | bsd license | (?:licen[cs]ed |released |distributed |available )?under (?:the terms of )?(?:the |a )?bsd license
bsd | 0.8 | bsd licensed | bsd licensed
bsd | 0.7 | bsd style | bsd style(?: license)
bsd | 0.7 | bsd license | (?:the )?(?:berkeley )?bsd license
bsd | 0.7 | bsd licence | (?:the )?bsd licence
bsd | 0.75 | license bsd | license bsd
bsd | 0.8 | opensource org licenses bsd | opensource org licenses bsd(?: license)?(?: [23] clause)?(?: php)?
# gnu
agpl-3 | 0.98 | gnu affero general public license | (?:the )?gnu affero general public license(?: agpl)?(?: as published by the free software foundation)?(?: either)? (?:version|v) ?3(?: 0)?(?: of the license)?(?: or (?:at your option )?any later version)?
agpl-3 | 0.95 | gnu affero general public license v3 | (?:the )?gnu affero general public license v3(?: 0)?
agpl | 0.8 | affero general public license | (?:the )?(?:gnu )?affero general public license
agpl-3 | 0.9 | agplv3 | (?:the )?(?:gnu )?agplv3(?: license)?
agpl-3 | 0.9 | agpl 3 | (?:the )?(?:gnu )?agpl 3(?: 0)?(?: only| or later)?
agpl-3 | 0.9 | agpl v3 | (?:the )?(?:gnu )?agpl v3(?: 0)?
agpl-3 | 0.85 | gnu org licenses agpl 3 0 | (?:www )?gnu org licenses agpl 3 0(?: html| txt)?
agpl | 0.7 | agpl | (?:under )?(?:the )?(?:gnu )?agpl(?: licen[cs]ed?)?
lgpl-3 | 0.98 | gnu lesser general public license | (?:the )?gnu lesser general public license(?: lgpl)?(?: as published by the free software foundation)?(?: either)? version 3(?: 0)?(?: of the license)?(?: or (?:at your option )?any later version)?
lgpl-2.1 | 0.98 | gnu lesser general public license | (?:the )?gnu lesser general public license(?: lgpl)?(?: as published by the free software foundation)?(?: either)? version 2 1(?: of the license)?(?: or (?:at your option )?any later version)?
lgpl-3 | 0.95 | gnu lesser general public license v3 | (?:the )?gnu lesser general public license v3(?: 0)?
lgpl-2.1 | 0.95 | gnu lesser general public license v2 1 | (?:the )?gnu lesser general public license v2 1
lgpl-2 | 0.95 | gnu library general public license | (?:the )?gnu library general public license(?: version 2(?: 0)?)?
lgpl-3 | 0.9 | lgplv3 | (?:the )?(?:gnu )?lgplv3(?: license)?
lgpl-2.1 | 0.9 | lgplv2 1 | (?:the )?(?:gnu )?lgplv2 1(?: license)?
lgpl-3 | 0.9 | lgpl 3 | (?:the )?(?:gnu )?lgpl 3(?: 0)?(?: only| or later)?
lgpl-2.1 | 0.9 | lgpl 2 1 | (?:the )?(?:gnu )?lgpl 2 1(?: only| or later)?
lgpl-3 | 0.9 | lgpl v3 | (?:the )?(?:gnu )?lgpl v3(?: 0)?
lgpl-2.1 | 0.9 | lgpl v2 1 | (?:the )?(?:gnu )?lgpl v2 1
lgpl-3 | 0.85 | gnu org licenses lgpl 3 0 | (?:www )?gnu org licenses lgpl 3 0(?: html| txt)?
lgpl-2.1 | 0.85 | gnu org licenses lgpl 2 1 | (?:www )?gnu org licenses lgpl 2 1(?: html| txt)?
lgpl | 0.8 | lesser general public license | (?:the )?(?:gnu )?lesser general public license
lgpl | 0.7 | lgpl | (?:under )?(?:the )?(?:gnu )?lgpl(?: licen[cs]ed?)?
gpl-3 | 0.98 | gnu general public license | (?:the )?gnu general public license(?: gpl)?(?: as published by the free software foundation)?(?: either)? version 3(?: 0)?(?: of the license)?(?: or (?:at your option )?any later version)?
gpl-2 | 0.98 | gnu general public license | (?:the )?gnu general public license(?: gpl)?(?: as published by the free software foundation)?(?: either)? version 2(?: 0)?(?: of the license)?(?: or (?:at your option )?any later version)?
gpl-1 | 0.98 | gnu general public license | (?:the )?gnu general public license(?: gpl)?(?: as published by the free software foundation)?(?: either)? version 1(?: 0)?(?: of the license)?(?: or (?:at your option )?any later version)?
gpl-3 | 0.95 | gnu general public license v3 | (?:the )?gnu general public license v3(?: 0)?
gpl-2 | 0.95 | gnu general public license v2 | (?:the )?gnu general public license v2(?: 0)?
gpl-3 | 0.9 | general public license 3 | (?:the )?(?:gnu )?general public license 3(?: 0)?
gpl-2 | 0.9 | general public license 2 | (?:the )?(?:gnu )?general public license 2(?: 0)?
gpl-3 | 0.9 | gplv3 | (?:(?:licen[cs]ed|released|distributed|available) under )?(?:the )?(?:gnu )?gplv3(?: 0)?(?: license)?(?: or later)?
gpl-2 | 0.9 | gplv2 | (?:(?:licen[cs]ed|released|distributed|available) under )?(?:the )?(?:gnu )?gplv2(?: 0)?(?: license)?(?: or later)?
gpl-3 | 0.9 | gpl 3 | (?:(?:licen[cs]ed|released|distributed|available) under )?(?:the )?(?:gnu )?gpl 3(?: 0)?(?: license)?(?: only| or later)?
gpl-2 | 0.9 | gpl 2 | (?:(?:licen[cs]ed|released|distributed|available) under )?(?:the )?(?:gnu )?gpl 2(?: 0)?(?: license)?(?: only| or later)?
gpl-3 | 0.9 | gpl v3 | (?:(?:licen[cs]ed|released|distributed|available) under )?(?:the )?(?:gnu )?gpl v3(?: 0)?(?: license)?
gpl-2 | 0.9 | gpl v2 | (?:(?:licen[cs]ed|released|distributed|available) under )?(?:the )?(?:gnu )?gpl v2(?: 0)?(?: license)?
gpl-3 | 0.9 | gpl version 3 | (?:the )?(?:gnu )?gpl version 3(?: 0)?(?: or later)?
gpl-2 | 0.9 | gpl version 2 | (?:the )?(?:gnu )?gpl version 2(?: 0)?(?: or later)?
gpl-3 | 0.85 | gnu org licenses gpl 3 0 | (?:www )?gnu org licenses gpl 3 0(?: html| txt)?
gpl-2 | 0.85 | gnu org licenses old licenses gpl 2 0 | (?:www )?gnu org licenses old licenses gpl 2 0(?: html| txt)?
gpl-3 | 0.85 | either version 3 of the license or | (?:free software foundation )?either version 3 of the license or (?:at your option )?any later version
gpl-2 | 0.85 | either version 2 of the license or | (?:free software foundation )?either version 2 of the license or (?:at your option )?any later version
gpl | 0.7 | you can redistribute it and or modify it under the terms of the gnu general public license | (?:this program is free software )?you can redistribute it and or modify it under the terms of the gnu general public license
gpl | 0.6 | gnu general public license | (?:the )?gnu general public license
gpl | 0.6 | you should have received a copy of the gnu general public license | you should have received a copy of the gnu general public license(?: along with this program)?
gpl | 0.7 | gpl | (?:licen[cs]ed|released|distributed|available) under (?:the )?(?:terms of the )?(?:gnu )?gpl(?: license)?
gpl | 0.7 | gpl licensed | (?:gnu )?gpl licensed
gpl | 0.6 | gnu gpl | (?:the )?gnu gpl(?: license)?
gpl | 0.6 | gpl license | (?:the )?gpl license
gfdl-1.3 | 0.95 | gnu free documentation license | (?:the )?gnu free documentation license(?: gfdl)? (?:version|v) ?1 3(?: or any later version)?
gfdl-1.2 | 0.95 | gnu free documentation license | (?:the )?gnu free documentation license(?: gfdl)? (?:version|v) ?1 2(?: or any later version)?
gfdl | 0.8 | free documentation license | (?:the )?(?:gnu )?free documentation license
gfdl | 0.7 | gfdl | (?:the )?(?:gnu )?gfdl(?: 1 [123])?
classpath | 0.85 | classpath exception | (?:with )?(?:the )?(?:gnu )?classpath exception
# mozilla, eclipse and other weak copyleft
mpl-2 | 0.98 | subject to the terms of the mozilla public license | (?:this source code form is )?subject to the terms of the mozilla public license (?:v|version) ?2(?: 0)?
mpl-2 | 0.95 | mozilla public license | (?:the )?mozilla public license(?: mpl)?(?: version| v)? ?2(?: 0)?
mpl-1.1 | 0.95 | mozilla public license | (?:the )?mozilla public license(?: mpl)?(?: version| v)? ?1 1
mpl-1 | 0.95 | mozilla public license | (?:the )?mozilla public license(?: mpl)?(?: version| v)? ?1 0
mpl-2 | 0.9 | mpl 2 0 | (?:(?:licen[cs]ed|released|distributed|available) under )?(?:the )?mpl 2 0(?: licen[cs]ed?)?
mpl-2 | 0.9 | mplv2 | (?:the )?mplv2(?: 0)?
mpl-2 | 0.9 | mpl v2 | (?:the )?mpl v2(?: 0)?
mpl-1.1 | 0.9 | mpl 1 1 | (?:the )?mpl 1 1
mpl-2 | 0.85 | mozilla org mpl 2 0 | mozilla org mpl 2 0
mpl | 0.6 | mozilla public license | (?:the )?mozilla public license
epl-2 | 0.95 | eclipse public license | (?:the )?eclipse public license(?: epl)?(?: version| v)? ?2(?: 0)?
epl-1 | 0.95 | eclipse public license | (?:the )?eclipse public license(?: epl)?(?: version| v)? ?1(?: 0)?
epl-2 | 0.85 | epl 2 0 | (?:the )?epl 2 0
epl-1 | 0.85 | epl 1 0 | (?:the )?epl 1 0
epl | 0.6 | eclipse public license | (?:the )?eclipse public license
cpl-1 | 0.85 | common public license | (?:the )?common public license(?: version| v)?(?: ?1(?: 0)?)?
ipl-1 | 0.85 | ibm public license | (?:the )?ibm public license(?: version)?(?: 1 0)?
cddl-1.1 | 0.95 | common development and distribution license | (?:the )?common development and distribution license(?: cddl)?(?: version| v)? ?1 1
cddl-1 | 0.9 | common development and distribution license | (?:the )?common development and distribution license(?: cddl)?(?:(?: version| v)? ?1 0)?
cddl-1 | 0.8 | cddl | (?:the )?cddl(?: license)?(?:(?: version| v)? ?1 [01])?
eupl-1.2 | 0.95 | european union public licen | (?:the )?european union public licen[cs]e(?: eupl)?(?: version| v)? ?1 2
eupl | 0.85 | european union public licen | (?:the )?european union public licen[cs]e
eupl | 0.8 | eupl | (?:the )?eupl(?: (?:version |v)?1 [012])?
osl-3 | 0.85 | open software license | (?:the )?open software license(?: version| v)?(?: ?3(?: 0)?)?
artistic-2 | 0.95 | artistic license 2 0 | (?:the )?artistic license 2 0
artistic-2 | 0.95 | artistic license version 2 | (?:the )?artistic license version 2(?: 0)?
artistic-1 | 0.75 | artistic license | (?:the )?(?:perl )?artistic license(?: 1 0)?
perl | 0.8 | same terms as perl itself | (?:under )?the same terms as perl itself
cecill | 0.85 | cecill | (?:the )?cecill(?: [bc])?(?: free software)?(?: license)?(?: agreement)?
qpl-1 | 0.8 | q public license | (?:the )?q public license(?: version)?(?: 1 0)?
sleepycat | 0.85 | sleepycat license | (?:the )?sleepycat license
watcom | 0.85 | sybase open watcom public license | (?:the )?sybase open watcom public license
ofl-1.1 | 0.95 | sil open font license | (?:licen[cs]ed under )?(?:the )?sil open font license(?: ofl)?(?: version| v)?(?: ?1 1)?
ofl-1.1 | 0.85 | open font license | (?:the )?open font license(?: version| v)?(?: ?1 1)?
lppl-1.3 | 0.9 | latex project public license | (?:the )?latex project public license(?: lppl)?(?: version)?(?: 1 3[abc]?)?
# creative commons
cc-by-nc-sa | 0.95 | attribution noncommercial sharealike | (?:creative commons )?attribution noncommercial sharealike(?: [1-4] [0-9])?(?: international| unported| generic)?(?: public)?(?: license)?
cc-by-nc-sa | 0.95 | attribution non commercial share alike | (?:creative commons )?attribution non commercial share alike(?: [1-4] [0-9])?(?: international| unported| generic)?(?: public)?(?: license)?
cc-by-nc-nd | 0.95 | attribution noncommercial noderiv | (?:creative commons )?attribution noncommercial noderiv(?:s|atives)(?: [1-4] [0-9])?(?: international| unported| generic)?(?: public)?(?: license)?
cc-by-nc | 0.95 | attribution noncommercial | (?:creative commons )?attribution noncommercial(?: [1-4] [0-9])?(?: international| unported| generic)?(?: public)?(?: license)?
cc-by-nc | 0.95 | attribution non commercial | (?:creative commons )?attribution non commercial(?: [1-4] [0-9])?(?: international| unported| generic)?(?: public)?(?: license)?
cc-by-sa | 0.95 | attribution sharealike | (?:creative commons )?attribution sharealike(?: [1-4] [0-9])?(?: international| unported| generic)?(?: public)?(?: license)?
cc-by-sa | 0.95 | attribution share alike | (?:creative commons )?attribution share alike(?: [1-4] [0-9])?(?: international| unported| generic)?(?: public)?(?: license)?
cc-by-nd | 0.95 | attribution noderiv | (?:creative commons )?attribution noderiv(?:s|atives)(?: [1-4] [0-9])?(?: international| unported| generic)?(?: public)?(?: license)?
cc-by-nd | 0.95 | attribution no deriv | (?:creative commons )?attribution no deriv(?:s|atives|ative works)(?: [1-4] [0-9])?(?: international| unported| generic)?(?: public)?(?: license)?
cc-by | 0.95 | creative commons attribution | (?:the )?creative commons attribution(?: [1-4] [0-9])?(?: international| unported| generic)?(?: public)?(?: license)?
cc-by-nc-sa | 0.9 | cc by nc sa | (?:licen[cs]ed under )?(?:a |the )?cc by nc sa(?: [1-4] [0-9])?(?: license)?
cc-by-nc-nd | 0.9 | cc by nc nd | (?:licen[cs]ed under )?(?:a |the )?cc by nc nd(?: [1-4] [0-9])?(?: license)?
cc-by-nc | 0.9 | cc by nc | (?:licen[cs]ed under )?(?:a |the )?cc by nc(?: [1-4] [0-9])?(?: license)?
cc-by-sa | 0.9 | cc by sa | (?:licen[cs]ed under )?(?:a |the )?cc by sa(?: [1-4] [0-9])?(?: license)?
cc-by-nd | 0.9 | cc by nd | (?:licen[cs]ed under )?(?:a |the )?cc by nd(?: [1-4] [0-9])?(?: license)?
cc-by | 0.9 | cc by | (?:licen[cs]ed under )?(?:a |the )?cc by [1-4] [0-9](?: license)?
cc-by | 0.8 | cc by | (?:licen[cs]ed|released|distributed|available|shared) under (?:a |the )?cc by(?: license)?
cc-by-nc-sa | 0.85 | creativecommons org licenses by nc sa | creativecommons org licenses by nc sa(?: [1-4] [0-9])?
cc-by-nc-nd | 0.85 | creativecommons org licenses by nc nd | creativecommons org licenses by nc nd(?: [1-4] [0-9])?
cc-by-nc | 0.85 | creativecommons org licenses by nc | creativecommons org licenses by nc(?: [1-4] [0-9])?
cc-by-sa | 0.85 | creativecommons org licenses by sa | creativecommons org licenses by sa(?: [1-4] [0-9])?
cc-by-nd | 0.85 | creativecommons org licenses by nd | creativecommons org licenses by nd(?: [1-4] [0-9])?
cc-by | 0.85 | creativecommons org licenses by | creativecommons org licenses by(?: [1-4] [0-9])?
cc0-1 | 0.9 | cc0 | (?:(?:licen[cs]ed|released|available) under )?(?:the )?(?:creative commons )?cc0(?: 1 0)?(?: universal)?(?: public domain dedication)?
cc0-1 | 0.85 | creativecommons org publicdomain zero | creativecommons org publicdomain zero(?: 1 0)?
cc-sampling | 0.8 | creative commons sampling | (?:the )?creative commons sampling(?: plus)?(?: 1 0)?
cc | 0.6 | creative commons license | (?:a |the )?creative commons license
# data and models
odbl-1 | 0.9 | open database license | (?:the )?(?:open data commons )?open database license(?: odbl)?(?: version| v)?(?: ?1 0)?
odbl-1 | 0.8 | odbl | (?:the )?odbl(?: (?:v|version )?1 0)?
odc-by-1 | 0.9 | open data commons attribution license | (?:the )?open data commons attribution license(?: odc by)?(?: v1 0)?
pddl-1 | 0.9 | public domain dedication and license | (?:the )?(?:open data commons )?public domain dedication and license(?: pddl)?(?: v1 0)?
cdla | 0.9 | community data license agreement | (?:the )?community data license agreement(?: permissive| sharing)?(?: version)?(?: [12] 0)?
ogl-3 | 0.85 | open government licen | (?:the )?open government licen[cs]e(?: version| v)?(?: ?[123](?: 0)?)?
openrail | 0.85 | open rail | (?:the )?(?:bigscience |creativeml )?open rail(?: [dmsa])*(?: license)?
openrail | 0.85 | openrail | (?:the )?(?:bigscience |creativeml )?openrail(?: ?m)?(?: license)?
# no license, or against use
public-domain | 0.85 | public domain | (?:dedicated to|placed in|released into|released to|is in|are in) the public domain
public-domain | 0.5 | public domain | in the public domain
all-rights-reserved | 0.6 | all rights reserved | (?:copyright [a-z0-9 ]{1,60})?all rights reserved
proprietary | 0.85 | proprietary and confidential | (?:this (?:file|software|document) is )?proprietary and confidential
proprietary | 0.8 | unauthorized copying of this file | unauthorized copying of this file(?: via any medium is strictly prohibited)?
proprietary | 0.75 | end user license agreement | (?:an |the |this )?end user license agreement(?: eula)?
proprietary | 0.7 | no part of this publication may be reproduced | no part of this publication may be reproduced
non-commercial | 0.7 | for non commercial use only | for non commercial use only
non-commercial | 0.7 | noncommercial purposes only | for noncommercial purposes only
no-warranty | 0.5 | without warranty of any kind | (?:the software is )?provided as is without warranty of any kind(?: express or implied)?
no-warranty | 0.4 | without even the implied warranty of merchantability | without even the implied warranty of merchantability(?: or fitness for a particular purpose)?
"""


def signatures() -> list[tuple[str, float, str, str]]:
    """(label, score, keyword, expression) in order of priority."""
    lines = [x for x in SIGNATURES.strip().split("\n") if not x.startswith("#")]
    rows = [[part.strip() for part in x.split(" | ")] for x in lines]
    return [(label, float(score), keyword, expression) for label, score, keyword, expression in rows]
