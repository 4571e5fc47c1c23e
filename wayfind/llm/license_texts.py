"""Texts of common licenses and notices that a scan looks for."""

from __future__ import annotations

_WARRANTY = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
    "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
    "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD_WARRANTY = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT "
    "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT "
    "HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT "
    "LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY "
    "THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF "
    "THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution. "
)


def _gnu(name: str, version: str, work: str = "program") -> str:
    return (
        f"This {work} is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software "
        f"Foundation, {version}. This {work} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied "
        f"warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details."
    )


#: Label, text, phrases that must stand in a file.
TEMPLATES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", ["permission is hereby granted", "free of charge"]),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _WARRANTY, ["deal in the software without restriction"]),
    ("mit", "Released under the MIT License.", ["mit license"]),
    ("mit", "This project is licensed under the terms of the MIT license.", ["mit license"]),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0.", ["apache license", "version 2 0"]),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.", ["apache license", "version 2 0"]),
    ("apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions. \"License\" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document.", ["apache license version 2 0"]),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2.", ["gnu general public license", "version 2"]),
    ("gpl-2.0", _gnu("GNU General Public License", "either version 2 of the License, or (at your option) any later version"), ["gnu general public license", "version 2"]),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3.", ["gnu general public license", "version 3"]),
    ("gpl-3.0", _gnu("GNU General Public License", "either version 3 of the License, or (at your option) any later version"), ["gnu general public license", "version 3"]),
    ("lgpl", "This library is licensed under the GNU Lesser General Public License.", ["lesser general public license"]),
    ("lgpl", _gnu("GNU Lesser General Public License", "either version 2.1 of the License, or (at your option) any later version", "library"), ["lesser general public license"]),
    ("lgpl", _gnu("GNU Lesser General Public License", "either version 3 of the License, or (at your option) any later version"), ["lesser general public license"]),
    ("agpl", "This work is licensed under the GNU Affero General Public License.", ["affero general public license"]),
    ("agpl", _gnu("GNU Affero General Public License", "either version 3 of the License, or (at your option) any later version"), ["affero general public license"]),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms"]),
    ("bsd-2-clause", _BSD + _BSD_WARRANTY, ["redistribution and use in source and binary forms", "redistributions in binary form must reproduce"]),
    ("bsd-3-clause", _BSD + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + _BSD_WARRANTY, ["redistribution and use in source and binary forms", "neither the name of"]),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", ["with or without fee is hereby granted"]),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.", ["with or without fee is hereby granted"]),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", ["mozilla public license"]),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", ["mozilla public license"]),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions", ["alter it and redistribute it freely"]),
    ("bsl-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software", ["software and accompanying documentation covered by this license"]),
    ("cc-by", "Licensed under CC BY 4.0.", ["cc by 4 0"]),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License.", ["creative commons attribution 4 0"]),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0.", ["cc by sa"]),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", ["attribution sharealike"]),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0.", ["cc by nc"]),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", ["attribution noncommercial"]),
    ("cc0", "To the extent possible under law, the author has waived all copyright under CC0 1.0 Universal.", ["cc0 1 0"]),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", ["waived all copyright and related or neighboring rights"]),
    ("unlicense", "This is free and unencumbered software released into the public domain.", ["free and unencumbered software"]),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.", ["free and unencumbered software"]),
    ("wtfpl", "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION", ["do what the fuck you want to"]),
]
