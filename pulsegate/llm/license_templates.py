"""Licence templates: one-line forms, notices and full texts (as published; parameters of the operator).

Long full texts lie beside this module in ``license_texts``.  The full texts of AGPL-3.0 and of the
Creative Commons licences other than CC0 are not among them: their notices and lines are.
"""

from __future__ import annotations

from importlib import resources

TEMPLATES: dict[str, str] = {
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance'
        " with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
    ),
    "MIT-line": "Released under the MIT License.",
    "MIT-licensed": "This project is licensed under the MIT License.",
    "MIT-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
        ' documentation files (the "Software"), to deal in the Software without restriction, including without limitation'
        " the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and"
        " to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
    ),
    "BSD-line": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "BSD-grant": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the"
        " following conditions are met:"
    ),
    "GPL-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public"
        " License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any"
        " later version."
    ),
    "MPL-2.0-notice": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not"
        " distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "CC-BY-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-line": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-line": "To the extent possible under law, the author has waived all copyright to this work (CC0 1.0).",
    "ISC-grant": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby"
        " granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
}

_MIT_REST = (
    " The above copyright notice and this permission notice shall be included in all copies or substantial portions of"
    ' the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT'
    " LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL"
    " THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF"
    " CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN"
    " THE SOFTWARE."
)
_BSD_SOURCE = (
    " Redistributions of source code must retain the above copyright notice, this list of conditions and the following"
    " disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the"
    " following disclaimer in the documentation and/or other materials provided with the distribution."
)
_BSD_NAMES = (
    " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products"
    " derived from this software without specific prior written permission."
)
_BSD_REST = (
    ' THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,'
    " INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE"
    " DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,"
    " SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR"
    " SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,"
    " WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE"
    " OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_ISC_REST = (
    ' THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL'
    " IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,"
    " INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN"
    " ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF"
    " THIS SOFTWARE."
)
TEMPLATES |= {
    "MIT-text": TEMPLATES["MIT-grant"] + _MIT_REST,
    "BSD-2-Clause-text": TEMPLATES["BSD-grant"] + _BSD_SOURCE + _BSD_REST,
    "BSD-3-Clause-text": TEMPLATES["BSD-grant"] + _BSD_SOURCE + _BSD_NAMES + _BSD_REST,
    "ISC-text": TEMPLATES["ISC-grant"] + _ISC_REST,
    "Unlicense-line": "This is free and unencumbered software released into the public domain.",
    "Unlicense-text": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish,"
        " use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any"
        " purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author"
        " or authors of this software dedicate any and all copyright interest in the software to the public domain. We make"
        " this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend"
        " this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software"
        ' under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING'
        " BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO"
        " EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT"
        " OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
        " For more information, please refer to <http://unlicense.org/>"
    ),
}
_GNU = {
    "GPL-2.0": ("GNU General Public License", "2"),
    "GPL-3.0": ("GNU General Public License", "3"),
    "LGPL-2.1": ("GNU Lesser General Public License", "2.1"),
    "LGPL-3.0": ("GNU Lesser General Public License", "3"),
    "AGPL-3.0": ("GNU Affero General Public License", "3"),
}
for _id, (_name, _version) in _GNU.items():
    TEMPLATES |= {
        f"{_id}-line": f"This work is licensed under the {_name}, version {_version}.",
        f"{_id}-released": f"Released under the {_name}, version {_version}.",
        f"{_id}-short": f"Licensed under the {_name} v{_version}.",
    }
    if _id != "GPL-3.0":
        TEMPLATES[f"{_id}-notice"] = (
            f"This program is free software: you can redistribute it and/or modify it under the terms of the {_name} as"
            f" published by the Free Software Foundation, either version {_version} of the License, or (at your option) any"
            " later version."
        )
for _id, _name in {
    "Apache-2.0": "Apache License, Version 2.0",
    "BSD-2-Clause": "BSD 2-Clause License",
    "BSD-3-Clause": "BSD 3-Clause License",
    "ISC": "ISC License",
    "MIT": "MIT License",
    "MPL-2.0": "Mozilla Public License, version 2.0",
}.items():
    for _form, _words in {"licensed-under": "Licensed under the", "released-under": "Released under the", "project": "This project is licensed under the"}.items():
        if f"{_words} {_name}." not in TEMPLATES.values():
            TEMPLATES[f"{_id}-{_form}"] = f"{_words} {_name}."
for _id, _name in {
    "BY": "Attribution",
    "BY-SA": "Attribution-ShareAlike",
    "BY-NC": "Attribution-NonCommercial",
    "BY-ND": "Attribution-NoDerivatives",
    "BY-NC-SA": "Attribution-NonCommercial-ShareAlike",
    "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives",
}.items():
    for _version, _scope in {"3.0": "Unported", "4.0": "International"}.items():
        TEMPLATES |= {
            f"CC-{_id}-{_version}-short": f"Licensed under CC {_id} {_version}.",
            f"CC-{_id}-{_version}-work": f"This work is licensed under CC {_id} {_version}.",
        }
        TEMPLATES.setdefault(
            f"CC-{_id}-{_version}-line", f"This work is licensed under a Creative Commons {_name} {_version} {_scope} License."
        )
TEMPLATES |= {"CC0-1.0-short": "Licensed under CC0 1.0.", "CC0-1.0-universal": "This work is dedicated to the public domain under CC0 1.0 Universal."}
for _id, _file in {
    "Apache-2.0": "Apache-2.0",
    "CC0-1.0": "CC0-1.0",
    "GPL-2.0": "GPL-2",
    "GPL-3.0": "GPL-3",
    "LGPL-2.1": "LGPL-2.1",
    "LGPL-3.0": "LGPL-3",
    "MPL-2.0": "MPL-2.0",
}.items():
    TEMPLATES[f"{_id}-text"] = resources.files("pulsegate.llm").joinpath("license_texts", f"{_file}.txt").read_text("utf-8")
