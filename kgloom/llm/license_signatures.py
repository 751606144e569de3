"""License signatures, one rule a line: label, tier and a regex over lower-case words.

The rules were written by hand; grants that differ in their verb only (licensed, released, ... under) were then
split into a line for each.

Tiers, best first: T a machine-readable tag, G a grant (the license's own words or "licensed under"), N a
license's name, O a notice that hints at one.  ``~`` stands for ``licen[sc]e``.  Of equal intervals in one
tier the earlier rule stays.
"""

SIGNATURES = """
mit T spdx ~ identifier (?:mit|x11)
mit G permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit G permission is hereby granted free of charge to any person obtaining a copy
mit G the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit G the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability
mit G in no event shall the authors or copyright holders be liable for any claim damages or other liability
mit G licensed under (?:the )?(?:terms of )?(?:the )?(?:mit|expat)(?: x11| expat)?(?: ~)?
mit G distributed under (?:the )?(?:terms of )?(?:the )?(?:mit|expat)(?: x11| expat)?(?: ~)?
mit G available under (?:the )?(?:terms of )?(?:the )?(?:mit|expat)(?: x11| expat)?(?: ~)?
mit G published under (?:the )?(?:terms of )?(?:the )?(?:mit|expat)(?: x11| expat)?(?: ~)?
mit G provided under (?:the )?(?:terms of )?(?:the )?(?:mit|expat)(?: x11| expat)?(?: ~)?
mit G covered under (?:the )?(?:terms of )?(?:the )?(?:mit|expat)(?: x11| expat)?(?: ~)?
mit G released under (?:the )?(?:terms of )?(?:the )?(?:mit|expat)(?: x11| expat)?(?: ~)?
mit N (?:the )?mit x11 ~
mit N (?:the )?mit expat ~
mit N (?:the )?mit ~s?
mit N (?:the )?expat ~
mit N (?:the )?x11 ~
mit N ~ (?:is )?mit
mit N mit licensed
mit O mit style ~
mit-0 T spdx ~ identifier mit 0
mit-0 G permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided as is
mit-0 N mit no attribution(?: ~)?
apache-1.0 T spdx ~ identifier apache 1 0
apache-1.0 N apache (?:software )?~ (?:version )?(?:v ?)?1 0
apache-1.1 T spdx ~ identifier apache 1 1
apache-1.1 N apache (?:software )?~ (?:version )?(?:v ?)?1 1
apache-1.1 G the end user documentation included with the redistribution if any must include the following acknowledg(?:e)?ment this product includes software developed by the apache software foundation
apache-2.0 T spdx ~ identifier apache 2 0
apache-2.0 G licensed under the apache ~ version 2 0
apache-2.0 G you may not use this file except in compliance with the ~ you may obtain a copy of the ~ at http www apache org licenses ~ 2 0
apache-2.0 G (?:http|https) www apache org licenses ~ 2 0
apache-2.0 G apache org licenses ~ 2 0
apache-2.0 G unless required by applicable law or agreed to in writing software distributed under the ~ is distributed on an as is basis
apache-2.0 G without warranties or conditions of any kind either express or implied see the ~ for the specific language governing permissions
apache-2.0 G licensed under (?:the )?(?:terms of )?(?:the )?apache(?: software)?(?: ~)?(?: version)? (?:v ?)?2(?: 0)?
apache-2.0 G released under (?:the )?(?:terms of )?(?:the )?apache(?: software)?(?: ~)?(?: version)? (?:v ?)?2(?: 0)?
apache-2.0 G distributed under (?:the )?(?:terms of )?(?:the )?apache(?: software)?(?: ~)?(?: version)? (?:v ?)?2(?: 0)?
apache-2.0 G available under (?:the )?(?:terms of )?(?:the )?apache(?: software)?(?: ~)?(?: version)? (?:v ?)?2(?: 0)?
apache-2.0 G published under (?:the )?(?:terms of )?(?:the )?apache(?: software)?(?: ~)?(?: version)? (?:v ?)?2(?: 0)?
apache-2.0 G provided under (?:the )?(?:terms of )?(?:the )?apache(?: software)?(?: ~)?(?: version)? (?:v ?)?2(?: 0)?
apache-2.0 N apache (?:software )?~s? (?:version )?(?:v ?)?2(?: 0)?
apache-2.0 N apache 2(?: 0)? ~
apache-2.0 N apache v2(?: 0)?(?: ~)?
apache-2.0 N apache ~ 2(?: 0)?
apache-2.0 N ~ apache 2(?: 0)?
apache-2.0 O terms and conditions for use reproduction and distribution
apache G licensed under (?:the )?(?:terms of )?(?:the )?apache(?: software)?(?: ~)?
apache G distributed under (?:the )?(?:terms of )?(?:the )?apache(?: software)?(?: ~)?
apache G available under (?:the )?(?:terms of )?(?:the )?apache(?: software)?(?: ~)?
apache G published under (?:the )?(?:terms of )?(?:the )?apache(?: software)?(?: ~)?
apache G provided under (?:the )?(?:terms of )?(?:the )?apache(?: software)?(?: ~)?
apache G released under (?:the )?(?:terms of )?(?:the )?apache(?: software)?(?: ~)?
apache N (?:the )?apache (?:software )?~s?
apache N apache licensed
apache O apache style ~
gpl-1.0 T spdx ~ identifier gpl 1 0(?: only)?
gpl-1.0 T spdx ~ identifier gpl 1 0 or later
gpl-1.0 N (?:gnu )?general public ~ (?:version )?(?:v ?)?1(?: 0)?
gpl-1.0 N gpl (?:version )?(?:v ?)?1(?: 0)?
gpl-1.0 N gplv1
gpl-2.0 T spdx ~ identifier gpl 2 0(?: only)?
gpl-2.0-or-later T spdx ~ identifier gpl 2 0 or later
gpl-2.0 N (?:gnu )?general public ~ (?:version )?(?:v ?)?2(?: 0)?
gpl-2.0-or-later N (?:gnu )?general public ~ (?:version )?(?:v ?)?2(?: 0)? or (?:any )?later
gpl-2.0-or-later G either version 2 of the ~ or at your option any later version
gpl-2.0 N gpl (?:version )?(?:v ?)?2(?: 0)?
gpl-2.0 N gplv2
gpl-2.0 N gnu gpl (?:version )?(?:v ?)?2(?: 0)?
gpl-2.0 O classpath exception
gpl-3.0 T spdx ~ identifier gpl 3 0(?: only)?
gpl-3.0-or-later T spdx ~ identifier gpl 3 0 or later
gpl-3.0 N (?:gnu )?general public ~ (?:version )?(?:v ?)?3(?: 0)?
gpl-3.0-or-later N (?:gnu )?general public ~ (?:version )?(?:v ?)?3(?: 0)? or (?:any )?later
gpl-3.0-or-later G either version 3 of the ~ or at your option any later version
gpl-3.0 N gpl (?:version )?(?:v ?)?3(?: 0)?
gpl-3.0 N gplv3
gpl-3.0 N gnu gpl (?:version )?(?:v ?)?3(?: 0)?
gpl-3.0 O gnu org licenses gpl 3 0
gpl G you can redistribute it and or modify it under the terms of the gnu general public ~
gpl G you should have received a copy of the gnu general public ~
gpl G licensed under (?:the )?(?:terms of )?(?:the )?(?:gnu )?gpl
gpl G distributed under (?:the )?(?:terms of )?(?:the )?(?:gnu )?gpl
gpl G available under (?:the )?(?:terms of )?(?:the )?(?:gnu )?gpl
gpl G published under (?:the )?(?:terms of )?(?:the )?(?:gnu )?gpl
gpl G provided under (?:the )?(?:terms of )?(?:the )?(?:gnu )?gpl
gpl G released under (?:the )?(?:terms of )?(?:the )?(?:gnu )?gpl
gpl G licensed under (?:the )?(?:terms of )?(?:the )?(?:gnu )?general public ~
gpl N (?:gnu )?general public ~
gpl N (?:gnu )?gpl ~
gpl N gnu gpl
gpl N gpl licensed
gpl O gnu org licenses gpl
gpl O copyleft
lgpl-2.0 T spdx ~ identifier lgpl 2 0(?: only| or later)?
lgpl-2.0 N (?:gnu )?library general public ~ (?:version )?(?:v ?)?2(?: 0)?
lgpl-2.0 N lgpl (?:version )?(?:v ?)?2 0
lgpl-2.1 T spdx ~ identifier lgpl 2 1(?: only)?
lgpl-2.1-or-later T spdx ~ identifier lgpl 2 1 or later
lgpl-2.1 N (?:gnu )?lesser general public ~ (?:version )?(?:v ?)?2 1
lgpl-2.1-or-later G either version 2 1 of the ~ or at your option any later version
lgpl-2.1 N lgpl (?:version )?(?:v ?)?2 1
lgpl-2.1 N lgplv2 1
lgpl-3.0 T spdx ~ identifier lgpl 3 0(?: only)?
lgpl-3.0-or-later T spdx ~ identifier lgpl 3 0 or later
lgpl-3.0 N (?:gnu )?lesser general public ~ (?:version )?(?:v ?)?3(?: 0)?
lgpl-3.0 N lgpl (?:version )?(?:v ?)?3(?: 0)?
lgpl-3.0 N lgplv3
lgpl G you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public ~
lgpl G licensed under (?:the )?(?:terms of )?(?:the )?(?:gnu )?lgpl
lgpl G released under (?:the )?(?:terms of )?(?:the )?(?:gnu )?lgpl
lgpl G distributed under (?:the )?(?:terms of )?(?:the )?(?:gnu )?lgpl
lgpl G available under (?:the )?(?:terms of )?(?:the )?(?:gnu )?lgpl
lgpl G published under (?:the )?(?:terms of )?(?:the )?(?:gnu )?lgpl
lgpl G provided under (?:the )?(?:terms of )?(?:the )?(?:gnu )?lgpl
lgpl N (?:gnu )?lesser general public ~
lgpl N (?:gnu )?library general public ~
lgpl N (?:gnu )?lgpl ~
lgpl N gnu lgpl
agpl-3.0 T spdx ~ identifier agpl 3 0(?: only)?
agpl-3.0-or-later T spdx ~ identifier agpl 3 0 or later
agpl-3.0 N (?:gnu )?affero general public ~ (?:version )?(?:v ?)?3(?: 0)?
agpl-3.0 N agpl (?:version )?(?:v ?)?3(?: 0)?
agpl-3.0 N agplv3
agpl-1.0 N affero general public ~ (?:version )?(?:v ?)?1(?: 0)?
agpl G you can redistribute it and or modify it under the terms of the gnu affero general public ~
agpl G licensed under (?:the )?(?:terms of )?(?:the )?(?:gnu )?agpl
agpl G released under (?:the )?(?:terms of )?(?:the )?(?:gnu )?agpl
agpl G distributed under (?:the )?(?:terms of )?(?:the )?(?:gnu )?agpl
agpl G available under (?:the )?(?:terms of )?(?:the )?(?:gnu )?agpl
agpl G published under (?:the )?(?:terms of )?(?:the )?(?:gnu )?agpl
agpl G provided under (?:the )?(?:terms of )?(?:the )?(?:gnu )?agpl
agpl N (?:gnu )?affero general public ~
agpl N (?:gnu )?agpl ~
gfdl T spdx ~ identifier gfdl 1 [123](?: only| or later)?
gfdl G permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation ~
gfdl N (?:gnu )?free documentation ~
gfdl N gfdl ~
bsd-0-clause T spdx ~ identifier 0bsd
bsd-0-clause N (?:zero|0) clause bsd(?: ~)?
bsd-0-clause N bsd zero clause(?: ~)?
bsd-0-clause N 0bsd ~
bsd-1-clause T spdx ~ identifier bsd 1 clause
bsd-1-clause N (?:one|1) clause bsd(?: ~)?
bsd-2-clause T spdx ~ identifier bsd 2 clause
bsd-2-clause N (?:two|2) clause bsd(?: ~)?
bsd-2-clause N bsd (?:two|2) clause(?: ~)?
bsd-2-clause N simplified bsd(?: ~)?
bsd-2-clause N freebsd ~
bsd-3-clause T spdx ~ identifier bsd 3 clause
bsd-3-clause N (?:three|3) clause bsd(?: ~)?
bsd-3-clause N bsd (?:three|3) clause(?: ~)?
bsd-3-clause N (?:new|modified|revised) bsd ~
bsd-3-clause G neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
bsd-3-clause G neither the name of (?:the )?[^ ]+(?: [^ ]+){0,8} nor the names of its contributors may be used to endorse
bsd-4-clause T spdx ~ identifier bsd 4 clause(?: uc)?
bsd-4-clause N (?:four|4) clause bsd(?: ~)?
bsd-4-clause N bsd (?:four|4) clause(?: ~)?
bsd-4-clause N (?:original|old) bsd ~
bsd-4-clause G all advertising materials mentioning features or use of this software must display the following acknowledg(?:e)?ment
bsd G redistribution and use in source and binary forms with or without modification are permitted
bsd G redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
bsd G redistributions in binary form must reproduce the above copyright notice
bsd G licensed under (?:the )?(?:terms of )?(?:the )?(?:a )?bsd(?: style)?(?: ~)?
bsd G released under (?:the )?(?:terms of )?(?:the )?(?:a )?bsd(?: style)?(?: ~)?
bsd G distributed under (?:the )?(?:terms of )?(?:the )?(?:a )?bsd(?: style)?(?: ~)?
bsd G available under (?:the )?(?:terms of )?(?:the )?(?:a )?bsd(?: style)?(?: ~)?
bsd G published under (?:the )?(?:terms of )?(?:the )?(?:a )?bsd(?: style)?(?: ~)?
bsd G provided under (?:the )?(?:terms of )?(?:the )?(?:a )?bsd(?: style)?(?: ~)?
bsd N (?:the )?bsd ~s?
bsd N bsd licensed
bsd N berkeley software distribution(?: ~)?
bsd O bsd style ~
bsd O bsd like ~
isc T spdx ~ identifier isc
isc G permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc N (?:the )?isc ~
isc N internet (?:software|systems) consortium ~
mpl-1.0 T spdx ~ identifier mpl 1 0
mpl-1.0 N mozilla public ~ (?:version )?(?:v ?)?1 0
mpl-1.1 T spdx ~ identifier mpl 1 1
mpl-1.1 N mozilla public ~ (?:version )?(?:v ?)?1 1
mpl-1.1 N mpl (?:version )?(?:v ?)?1 1
mpl-2.0 T spdx ~ identifier mpl 2 0
mpl-2.0 G this source code form is subject to the terms of the mozilla public ~ v 2 0
mpl-2.0 N mozilla public ~ (?:version )?(?:v ?)?2(?: 0)?
mpl-2.0 N mpl (?:version )?(?:v ?)?2(?: 0)?
mpl-2.0 O mozilla org mpl 2 0
mpl G subject to the terms of the mozilla public ~
mpl N mozilla public ~
mpl N mpl ~
epl-1.0 T spdx ~ identifier epl 1 0
epl-1.0 N eclipse public ~ (?:version )?(?:v ?)?1(?: 0)?
epl-2.0 T spdx ~ identifier epl 2 0
epl-2.0 N eclipse public ~ (?:version )?(?:v ?)?2(?: 0)?
epl-2.0 G this program and the accompanying materials are made available under the terms of the eclipse public ~ 2 0
epl G this program and the accompanying materials are made available under the terms of the eclipse public ~
epl N eclipse public ~
edl N eclipse distribution ~
cddl-1.0 T spdx ~ identifier cddl 1 0
cddl-1.1 T spdx ~ identifier cddl 1 1
cddl N common development and distribution ~
cddl N cddl ~
cpl-1.0 N common public ~
cpal-1.0 N common public attribution ~
ipl-1.0 N ibm public ~
apsl-2.0 N apple public source ~
artistic-1.0 T spdx ~ identifier artistic 1 0(?: perl| cl8)?
artistic-1.0 N (?:perl )?artistic ~ (?:version )?(?:v ?)?1(?: 0)?
artistic-2.0 T spdx ~ identifier artistic 2 0
artistic-2.0 N artistic ~ (?:version )?(?:v ?)?2(?: 0)?
artistic N (?:clarified |perl )?artistic ~
artistic G under the same terms as perl itself
bsl-1.0 T spdx ~ identifier bsl 1 0
bsl-1.0 N boost software ~
bsl-1.0 G permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this ~
busl-1.1 T spdx ~ identifier busl 1 1
busl-1.1 N business source ~
zlib T spdx ~ identifier (?:zlib|libpng)
zlib G altered source versions must be plainly marked as such
zlib G permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely
zlib N (?:zlib|libpng)(?: libpng)? ~
unlicense T spdx ~ identifier unlicense
unlicense G this is free and unencumbered software released into the public domain
unlicense N the unlicense
unlicense O unlicense org
wtfpl T spdx ~ identifier wtfpl
wtfpl N do what the fuck you want to public ~
wtfpl N wtfpl
cc0-1.0 T spdx ~ identifier cc0 1 0
cc0-1.0 N cc0(?: 1 0)?(?: universal)?
cc0-1.0 N creative commons zero
cc0-1.0 O creativecommons org publicdomain zero
cc-by-4.0 T spdx ~ identifier cc by 4 0
cc-by-4.0 N creative commons attribution 4 0(?: international)?
cc-by-4.0 N cc by 4 0
cc-by-4.0 O creativecommons org licenses by 4 0
cc-by-3.0 T spdx ~ identifier cc by 3 0
cc-by-3.0 N creative commons attribution 3 0(?: unported)?
cc-by-3.0 N cc by 3 0
cc-by-3.0 O creativecommons org licenses by 3 0
cc-by N creative commons attribution(?: ~)?
cc-by N cc by
cc-by-sa-4.0 T spdx ~ identifier cc by sa 4 0
cc-by-sa-4.0 N creative commons attribution share ?alike 4 0(?: international)?
cc-by-sa-4.0 N cc by sa 4 0
cc-by-sa-3.0 T spdx ~ identifier cc by sa 3 0
cc-by-sa-3.0 N creative commons attribution share ?alike 3 0(?: unported)?
cc-by-sa-3.0 N cc by sa 3 0
cc-by-sa N creative commons attribution share ?alike(?: ~)?
cc-by-sa N cc by sa
cc-by-nc-4.0 T spdx ~ identifier cc by nc 4 0
cc-by-nc-4.0 N creative commons attribution non ?commercial 4 0(?: international)?
cc-by-nc-4.0 N cc by nc 4 0
cc-by-nc N creative commons attribution non ?commercial(?: ~)?
cc-by-nc N cc by nc
cc-by-nc-sa-4.0 T spdx ~ identifier cc by nc sa 4 0
cc-by-nc-sa-4.0 N cc by nc sa 4 0
cc-by-nc-sa N creative commons attribution non ?commercial share ?alike(?: ~)?
cc-by-nc-sa N cc by nc sa
cc-by-nd-4.0 N cc by nd 4 0
cc-by-nd N creative commons attribution no ?deriv(?:s|atives)(?: ~)?
cc-by-nd N cc by nd
cc-by-nc-nd-4.0 N cc by nc nd 4 0
cc-by-nc-nd N creative commons attribution non ?commercial no ?deriv(?:s|atives)(?: ~)?
cc-by-nc-nd N cc by nc nd
creative-commons N creative commons ~
creative-commons O some rights reserved
odbl-1.0 T spdx ~ identifier odbl 1 0
odbl-1.0 N open (?:data commons open )?database ~
odc-by-1.0 N open data commons attribution ~
pddl-1.0 N public domain dedication and ~
ogl-uk N open government ~
ofl-1.1 T spdx ~ identifier ofl 1 1
ofl-1.1 N (?:sil )?open font ~
ofl-1.1 G this font software is licensed under the sil open font ~
psf-2.0 T spdx ~ identifier (?:psf|python) 2 0
psf-2.0 N python software foundation ~
php-3.01 T spdx ~ identifier php 3 01
php N php ~
ruby T spdx ~ identifier ruby
ruby N ruby ~
postgresql T spdx ~ identifier postgresql
postgresql N postgresql ~
postgresql G permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
openssl N openssl ~
openssl G this product includes software developed by the openssl project
ncsa T spdx ~ identifier ncsa
ncsa N (?:university of illinois )?ncsa (?:open source )?~
ms-pl T spdx ~ identifier ms pl
ms-pl N microsoft public ~
ms-rl N microsoft reciprocal ~
eupl-1.2 T spdx ~ identifier eupl 1 2
eupl-1.1 T spdx ~ identifier eupl 1 1
eupl N european union public ~
eupl N eupl ~
cecill T spdx ~ identifier cecill(?: 2 1| b| c)?
cecill N cecill(?: b| c)? ~
osl-3.0 N open software ~
afl-3.0 N academic free ~
upl-1.0 N universal permissive ~
sspl-1.0 N server side public ~
elastic-2.0 N elastic ~
mulan-psl N mulan (?:permissive software|psl) ~
w3c N w3c (?:software )?(?:notice and )?~
vim N vim ~
sleepycat N sleepycat ~
qpl-1.0 N q public ~
intel N intel open source ~
blueoak N blue oak model ~
nasa N nasa open source agreement
lppl N latex project public ~
json N the software shall be used for good not evil
beerware N beer ?ware ~
curl N curl ~
libtiff N libtiff ~
unicode N unicode (?:data files and software )?~
public-domain N (?:released|dedicated|placed) (?:in|in to|into|to) the public domain
public-domain O (?:in )?the public domain
proprietary N proprietary and confidential
proprietary N this software is the confidential and proprietary information of
proprietary N unauthorized copying of this file via any medium is strictly prohibited
commercial N commercial ~
eula N end user ~ agreement
all-rights-reserved O all rights reserved
copyright O copyright (?:c )?(?:19|20)[0-9][0-9]
copyright O copyright (?:c )?by
license-file O see the ~ file(?: for details)?
license-file O see (?:the )?accompanying ~
free-software O this is free software
no-warranty O without any warranty
no-warranty O comes with absolutely no warranty
"""
