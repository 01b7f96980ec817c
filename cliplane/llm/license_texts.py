"""Wording of licenses with template markup, as fixed values: `-text` is a whole license, `-notice` what files say about it."""

from __future__ import annotations

#: Base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

_BSD_HEAD = """
redistribution and use in source and binary forms <<beginOptional>>with or without modification<<endOptional>> are permitted
provided that the following conditions are met
<<beginOptional>><<var;name="bullet";original="1.";match="1|a|i|">><<endOptional>>
redistributions of source code must retain the <<beginOptional>>above<<endOptional>> copyright notice this list of conditions
and the following disclaimer
<<beginOptional>><<var;name="bullet";original="2.";match="2|b|ii|">><<endOptional>>
redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer
in the documentation and or other materials provided with the distribution
"""
_BSD_TAIL = """
this software is provided by <<var;name="holder";original="the copyright holders and contributors";match=".{1,1000}">> as is
and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for
a particular purpose are disclaimed in no event shall <<var;name="owner";original="the copyright owner or contributors";match=".{1,1000}">>
be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to
procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any
theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of
the use of this software even if advised of the possibility of such damage
"""
_NO_ENDORSEMENT = """
<<beginOptional>><<var;name="bullet";original="3.";match="3|4|c|d|iii|iv|">><<endOptional>>
neither the name of <<var;name="organization";original="the copyright holder";match=".{1,1000}">> nor the names of its
contributors may be used to endorse or promote products derived from this software without specific prior written permission
"""
_ADVERTISING = """
<<beginOptional>><<var;name="bullet";original="3.";match="3|c|iii|">><<endOptional>>
all advertising materials mentioning features or use of this software must display the following acknowledgement
this product includes software developed by <<var;name="organization";original="the organization";match=".{1,1000}">>
"""
_ISC_GRANT = """
permission to use copy modify and <<beginOptional>>or<<endOptional>> distribute this software for any purpose with or without
fee is hereby granted
"""
_ISC_TAIL = """
the software is provided as is and <<var;name="holder";original="the author";match=".{1,1000}">> disclaims all warranties with
regard to this software including all implied warranties of merchantability and fitness in no event shall
<<var;name="holder";original="the author";match=".{1,1000}">> be liable for any special direct indirect or consequential
damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or
other tortious action arising out of or in connection with the use or performance of this software
"""
_GNU_TAIL = """
<<beginOptional>>this <<var;match="program|library|software|file">> is distributed in the hope that it will be useful but
without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu
<<var;match="general|lesser general|affero general">> public license for more details<<endOptional>>
"""
_GNU_FREE = """
is free software you can redistribute it and or modify it under the terms of the gnu
"""
_GNU_PUBLISHED = """
public license as published by the free software foundation
"""
_LATER = """<<beginOptional>>of the license<<endOptional>> <<var;name="or later";original="or";match="or at your option any later version|or any later version|">>"""
_VERB = '<<var;match="released|licensed|distributed|available|published">>'

TEMPLATES = {
    "mit-text": """
permission is hereby granted free of charge to any person obtaining a copy of
<<var;name="work";original="this software";match="this software|this work">> and <<beginOptional>>its<<endOptional>> associated
documentation files the <<var;match="software|materials">> to deal in the <<var;match="software|materials">> without restriction
including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the
<<var;match="software|materials">> and to permit persons to whom the <<var;match="software|materials">> is furnished to do so
subject to the following conditions
the above copyright notice and this permission notice <<beginOptional>>including the next paragraph<<endOptional>> shall be
included in all copies or substantial portions of the <<var;match="software|materials">>
the <<var;match="software is|materials are">> provided as is without warranty of any kind express or implied including but not
limited to the warranties of merchantability fitness for a particular purpose and <<beginOptional>>non<<endOptional>>
<<var;match="infringement|noninfringement">> in no event shall <<var;name="holder";original="the authors or copyright holders";match=".{1,1000}">>
be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or
in connection with the <<var;match="software|materials">> or the use or other dealings in the <<var;match="software|materials">>""",
    "isc-text": _ISC_GRANT
    + "provided that the above copyright notice and this permission notice appear in all copies"
    + _ISC_TAIL,
    "0bsd-text": _ISC_GRANT + _ISC_TAIL,
    "bsd-2-clause-text": _BSD_HEAD + _BSD_TAIL,
    "bsd-3-clause-text": _BSD_HEAD + _NO_ENDORSEMENT + _BSD_TAIL,
    "bsd-4-clause-text": _BSD_HEAD + _ADVERTISING + _NO_ENDORSEMENT + _BSD_TAIL,
    "zlib-text": """
this software is provided as is without any express or implied warranty in no event will the authors be held liable for any
damages arising from the use of this software permission is granted to anyone to use this software for any purpose including
commercial applications and to alter it and redistribute it freely subject to the following restrictions
<<var;match="1|">> the origin of this software must not be misrepresented you must not claim that you wrote the original
software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not
required <<var;match="2|">> altered source versions must be plainly marked as such and must not be misrepresented as being the
original software <<var;match="3|">> this notice may not be removed or altered from any source distribution""",
    "bsl-1.0-text": """
permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying
documentation covered by this license the software to use reproduce display distribute execute and transmit the software and
to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all
subject to the following
the copyright notices in the software and this entire statement including the above license grant this restriction and the
following disclaimer must be included in all copies of the software in whole or in part and all derivative works of the
software unless such copies or derivative works are solely in the form of machine executable object code generated by a
source language processor
the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of
merchantability fitness for a particular purpose title and non infringement in no event shall the copyright holders or anyone
distributing the software be liable for any damages or other liability whether in contract tort or otherwise arising from out
of or in connection with the software or the use or other dealings in the software""",
    "unlicense-text": """
this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell
or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial
and by any means
in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest
in the software to the public domain we make this dedication for the benefit of the public at large and to the detriment of
our heirs and successors we intend this dedication to be an overt act of relinquishment in perpetuity of all present and
future rights to this software under copyright law
the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of
merchantability fitness for a particular purpose and noninfringement in no event shall the authors be liable for any claim
damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the
software or the use or other dealings in the software""",
    "apache-2.0-boilerplate": """
licensed under the apache license version 2 0 the license you may not use <<var;match="this file|this work|these files">> except
in compliance with the license you may obtain a copy of the license at <<var;name="url";original="http://www.apache.org/licenses/LICENSE-2.0";match="https?( www)? apache org licenses license 2 0( html| txt)?">>
unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is
basis without warranties or conditions of any kind either express or implied see the license for the specific language
governing permissions and limitations under the license""",
    "gpl-header": """<<beginOptional>>this <<var;match="program|software|file|library">><<endOptional>>"""
    + _GNU_FREE + "general" + _GNU_PUBLISHED + """<<beginOptional>>either<<endOptional>> version <<var;match="[123]">> """
    + _LATER + _GNU_TAIL,
    "lgpl-header": """<<beginOptional>>this <<var;match="program|software|file|library">><<endOptional>>"""
    + _GNU_FREE + '<<var;match="lesser|library">> general' + _GNU_PUBLISHED
    + """<<beginOptional>>either<<endOptional>> version <<var;match="2|3|2 1|2 0|3 0">> """ + _LATER + _GNU_TAIL,
    "agpl-header": """<<beginOptional>>this <<var;match="program|software|file|library">><<endOptional>>"""
    + _GNU_FREE + "affero general" + _GNU_PUBLISHED + """<<beginOptional>>either<<endOptional>> version <<var;match="3|3 0">> """
    + _LATER + _GNU_TAIL,
    "mpl-2.0-header": """
this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with
this file you can obtain one at <<var;match="https?( www)? mozilla org mpl 2 0">>""",
    "mit-notice": _VERB + """ under the <<beginOptional>>terms of the<<endOptional>> mit license""",
    "apache-2.0-notice": _VERB
    + """ under the <<beginOptional>>terms of the<<endOptional>> apache license <<beginOptional>>version<<endOptional>> 2 0""",
    "gpl-notice": _VERB + """ under the <<beginOptional>>terms of the<<endOptional>> gnu
<<var;match="general|lesser general|affero general">> public license
<<beginOptional>><<beginOptional>>as published by the free software foundation<<endOptional>> version
<<var;match="[123]( [01])?">><<endOptional>>""",
    "cc-notice": _VERB + """ under <<var;match="a|the|">> <<var;match="cc|creative commons">>
<<var;match="by|by sa|by nd|by nc|by nc sa|by nc nd|attribution|attribution sharealike">>
<<beginOptional>><<var;match="[1-4]">> 0<<endOptional>>""",
}

#: Identifiers of licenses in tags, as words. `only`, `or later` and a plus sign may follow where versions do.
IDENTIFIERS = (
    "mit", "mit 0", "apache 2 0", "apache 1 1", "bsd 2 clause", "bsd 3 clause", "bsd 4 clause", "0bsd", "isc", "zlib", "bsl 1 0",
    "gpl 1 0", "gpl 2 0", "gpl 3 0", "lgpl 2 0", "lgpl 2 1", "lgpl 3 0", "agpl 1 0", "agpl 3 0", "mpl 1 1", "mpl 2 0", "epl 1 0",
    "epl 2 0", "eupl 1 2", "cddl 1 0", "cc0 1 0", "cc by 3 0", "cc by 4 0", "cc by sa 3 0", "cc by sa 4 0", "cc by nc 4 0",
    "artistic 2 0", "ofl 1 1", "unlicense", "wtfpl", "python 2 0", "psf 2 0", "postgresql", "ncsa", "x11", "upl 1 0", "blueoak 1 0 0",
)


def _tag(identifier: str) -> str:
    """A tag that names this license alone, or behind another one in an expression."""
    later = '<<var;match="only|or later|">>' if "gpl" in identifier else ""
    other = f"""<<beginOptional>><<var;match="{'|'.join(IDENTIFIERS)}">> <<var;match="only|or later|">> <<var;match="or|and">><<endOptional>>"""
    return f"spdx license identifier {other} {identifier} {later}"


TEMPLATES |= {"spdx-" + name.replace(" ", "-"): _tag(name) for name in IDENTIFIERS}
