"""The labelled table of problem 1: sentences as clerks write them, with marked personal data.

``sentences`` fills about a hundred marked patterns with made-up names, numbers
and places. ``{slot}`` is filled and labelled, everything else is outside. Size
and seed are parameters; the table is small and made anew where it is needed.
"""

from __future__ import annotations

import random
import unicodedata

# Common family names and name syllables of Vietnam.
FAMILY = "Nguyễn Trần Lê Phạm Hoàng Huỳnh Phan Vũ Võ Đặng Bùi Đỗ Hồ Ngô Dương Lý Lâm Tạ Tô Quách Trịnh Đinh Mai Cao Đoàn Lương Thái Chu Hà Châu Tăng Kiều".split()
MIDDLE = "Văn Thị Đức Hữu Minh Quang Thanh Ngọc Xuân Gia Bảo Khánh Thiên Hải Hoài Diễm Thụy Tuyết Mộc Nhã Vĩnh Công Đình Quốc Kim Mỹ Như Anh Tấn Trọng".split()
GIVEN = "An Anh Ái Bách Bình Bửu Cẩm Châu Chương Cường Dũng Duyên Đạt Đông Giang Hà Hạnh Hậu Hiển Hiếu Hoa Hòa Hùng Hương Khoa Khuê Kiệt Lan Linh Loan Long Lộc Mai Mẫn My Nam Nga Ngân Nghĩa Nhàn Oanh Phong Phúc Phương Quyên Rạng Sáng Sơn Sương Tâm Thảo Thịnh Thoại Thủy Tiến Tiệp Trâm Trang Trường Tuấn Tường Tùng Uyên Việt Vượng Vy Xoan Yến".split()
FIRST = "James William Robert Thomas Gregory Deborah Margaret Katherine Victoria Frederick Alexander Nicholas Michael John Mary Susan Peter Paul Anna Laura Helen Edward Henry George Alice Charles Emily Oliver".split()
SYLLABLES = ("ab al am ar bel ber cor dun el en fen gal grey hal hol ken lin lor mar mil nor os pem quen ral sel stav ster thorn tul var wes win wood ley more den ford ham march lock land holt brook worth rich ander nall brell vard mann moor nell tyn dale").split()
PLACES = "An Bình Bắc Bạch Cẩm Cầu Châu Đại Đạo Đình Đông Đồi Gạch Gạo Giao Giang Hạ Hàng Hòa Hoa Hồng Hưng Khê Khương Kỳ Lạc Lâm Lĩnh Lò Long Lộc Lụa Mai Mây Mộc Nam Nghi Ngõ Nguyên Ninh Phú Phước Quế Suối Sơn Tân Tây Thạch Thạnh Thông Thượng Thủy Trạch Trầu Trường Từ Vàng Vân Vĩnh Xanh Xuyên".split()
UNITS = "Phòng Đào tạo|Phòng Kế hoạch - Tài chính|Phòng Tổ chức - Hành chính|Phòng Công tác sinh viên|Phòng Quản trị thiết bị|Phòng Hợp tác quốc tế|Ban Giám hiệu|Ban Thanh tra nhân dân|Ban Quản lý ký túc xá|Bộ phận Văn thư|Hội đồng khoa học|Hội đồng thi đua|Hội đồng trường|Kho lưu trữ cơ quan|Khoa Công nghệ thông tin|Khoa Kinh tế|Khoa Điều dưỡng|Thư viện trung tâm|Trung tâm Khảo thí|Tổ công tác số hóa".split("|")
BODIES = "Công ty Cổ phần|Trường Đại học|Trường Cao đẳng|Viện Nghiên cứu|Sở Giáo dục|Trung tâm Đào tạo|Công ty TNHH|Cty.|ĐH.|Ủy ban nhân dân xã|Bệnh viện|Ngân hàng".split("|")
VERBS = "rà soát|thu hồi|hủy bỏ|xác nhận|bàn giao|lưu trữ|phân loại|đối chiếu|sao lục|thẩm định|thanh lý|gia hạn|niêm yết|công bố|cập nhật|điều chỉnh|đính chính|phát hành|trình duyệt|giải trình|tổng hợp|kiểm tra|lập danh sách".split("|")
THINGS = "hồ sơ học bổng của sinh viên|quy chế đào tạo theo tín chỉ|bảng điểm học kỳ hai|chứng từ thanh toán học phí|kế hoạch kiểm kê tài sản|danh mục tài liệu lưu trữ|nội quy phòng thí nghiệm|đề án mở ngành mới|giấy tờ miễn giảm học phí|lịch trực bảo vệ cuối tuần|biên bản nghiệm thu thiết bị|quy định sử dụng con dấu|phiếu khảo sát người học|dữ liệu quét của hộp hồ sơ cũ|hợp đồng thỉnh giảng|sổ theo dõi công văn đi và đến|thỏa thuận hợp tác thực tập|đề cương chi tiết học phần".split("|")
TITLES = "Ông|Bà|Anh|Chị|Cô|Thầy|ông|bà|anh|chị|cô|thầy|em|Em|Sinh viên|sinh viên|TS.|ThS.|PGS.TS.|GS.|GS.TS.|BS.|Mr.|Ms.|Mrs.|Dr.".split("|")
POSTS = "Trưởng phòng|Giám đốc|Hiệu trưởng|Chủ tịch Hội đồng|Chánh Văn phòng|Kế toán trưởng|Trưởng khoa|Phó Hiệu trưởng".split("|")

WITH = """
{title} [name], điện thoại [phone], thư điện tử [email].
[name], điện thoại [phone], thư điện tử [email].
{title} [name], thường trú tại [address], được xét cấp học bổng.
[name], thường trú tại [address], được xét cấp học bổng.
Bên B do [name] đại diện, {id} [idno], địa chỉ [address], ĐT [phone].
Bên A do {title} [name] đại diện, {id} [idno], địa chỉ [address], ĐT [phone].
Người được ủy quyền: [name], {id} [idno], cấp ngày {date}.
Người được ủy quyền: {title} [name], {id} [idno], cấp ngày {date}.
Hồ sơ gửi về địa chỉ [address] trước 16 giờ.
Mọi thắc mắc xin liên hệ số máy [phone] hoặc gửi thư về [email].
Liên hệ: [email] - Tel: [phone].
Liên hệ: [phone] - Email: [email].
{title} [name] can be reached at [phone] or [email] during office hours.
Chủ hộ [name] cư ngụ ở [address], có con là [name], nay xin vắng thi.
Đoàn công tác gồm [name], [name] và [name], do {post} cử đi.
Đoàn công tác gồm {title} [name] và {title} [name], do {post} cử đi.
Thư ký cuộc họp là [name] và [name].
Họ và tên: [name]; {id} [idno]; nơi ở hiện nay: [address].
Họ và tên: [name]; {id} [idno]; nơi ở hiện nay: [address]. {filler}
Họ tên: [name]; Điểm: {n}; Lớp: {n};
STT: {n}; Họ tên: [name]; Điểm: A+; Học phần: {thing};
Kính gửi: {title} [name] - [address].
Kính gửi: [name] - [address].
[name]; [phone]; [email].
[name] - [phone] / [email].
[name] / [phone] / [email].
[name] / [phone] - [email].
[name] - [phone] - [email]
{title} [name] - [phone].
Theo đề nghị của {title} [name], {unit} sẽ {verb} {thing}.
Theo đề nghị của [name], {unit} sẽ {verb} {thing}.
{title} [name]
[name]
{postcaps} {title} [name]
{title} [name] {verb} {thing} tại TP. {place}.
Người ký là {title} [name], {post}.
Người lập biểu: [name]
Bản quét do [name] thực hiện, {post} xác nhận.
<tr><td>{n}</td><td>[name]</td><td>[pid]</td><td>8,1</td></tr>
<table><thead><tr><th>STT</th><th>Họ và tên</th><th>Số định danh</th><th>Điểm</th></tr></thead><tbody><tr><td>1</td><td>[name]</td><td>[pid]</td><td>6,9</td></tr><tr><td>2</td><td>[name]</td><td>SV{n5}</td><td>5,2</td></tr></tbody></table>
<tr><td>{n}</td><td>[name]</td><td>SV{n5}</td><td>4,8</td></tr></tbody></table>
{filler} {title} [name], điện thoại [phone], thư điện tử [email]. {filler}
{filler} Hồ sơ gửi về địa chỉ [address] trước 16 giờ. {filler}
{filler} Mọi thắc mắc xin liên hệ số máy [phone] hoặc gửi thư về [email]. {filler}
{filler} Thư ký cuộc họp là [name] và [name]. {filler}
{filler} {title} [name], thường trú tại [address], được xét cấp học bổng. {filler}
{filler} [name]; [phone]; [email]. {filler}
Điều {n}. Chủ hộ [name] cư ngụ ở [address], có con là [name], nay xin vắng thi. {filler}
{n}. Bên B do [name] đại diện, {id} [idno], địa chỉ [address], ĐT [phone]. {filler}
Điều {n}. [name], thường trú tại [address], được xét cấp học bổng. {filler}
{n}. Liên hệ: [email] - Tel: [phone]. {filler}
b) Kính gửi: {title} [name] - [address]. {filler}
Người liên hệ: [name], {post}, số điện thoại [phone]. {filler}
Giấy tờ của {title} [name] gồm {id} [idno]. {filler}
Sinh ngày {date}, {id} [idno], ngụ tại [address].
""".strip().split("\n")

WITHOUT = """
{filler} {filler}
{filler}
{n}. {filler} {filler}
Điều {n}. {filler}
a) {filler}
Biên lai {n9} ghi số tiền {money} đồng, kèm vận đơn {code7}. {filler}
{filler} Biên lai {n9} ghi số tiền {money} đồng, kèm vận đơn {code7}.
Mã số thuế của đơn vị là {n10}, tài khoản {n12} tại kho bạc. {filler}
{filler} Mã số thuế của đơn vị là {n10}, tài khoản {n12} tại kho bạc.
Tệp đính kèm bang_diem@ky{d} nằm trong thư mục 20{d}{d}.{n3}.{n3} trên máy chủ. {filler}
{filler} Tệp đính kèm bang_diem@ky{d} nằm trong thư mục 20{d}{d}.{n3}.{n3} trên máy chủ.
{body} {place}
{bodycaps}
{bodycaps} CỘNG HÒA XÃ HỘI CHỦ NGHĨA VIỆT NAM Độc lập - Tự do - Hạnh phúc
{unit} / Hộp {n}
{body} {place} • Lưu trữ - trang {d}/{d}
{body} {place} - Lưu hành nội bộ | {d}
Bản quét lưu kho {place} - trang {d}/{d}
{postcaps}
Nơi nhận: - Như Điều {d}; - Lưu VT, TCHC.
Quyết định về việc {verb} {thing}
Căn cứ Quyết định số {n}/QĐ-ĐHĐH-TCHC ngày {date} về việc {verb} {thing};
Căn cứ Quyết định số {n}/TTr-VNCVL-K3 {date} về việc {verb} {thing};
{body} {place} và {body} {place} ký thỏa thuận số {n}/KH-ĐHSV-ĐT. {filler}
Sinh viên mã số SV{n5} đăng ký học phần {course} tại cơ sở CS{d}.
Mã sinh viên {n8} chưa nộp {thing}. {filler}
STT: {n}; Điểm: {n}; Ghi chú: {thing}; Lớp: A+;
Học phần: {n}; Tín chỉ: {thing}; Điểm: A+; Điểm: {n};
Buổi lễ diễn ra tại P. {n}, Q. {d}, TP. {place}, lúc 9.30 ngày {date}.
Số tài khoản {n12} mở tại Ngân hàng {place}. {filler}
Mã hồ sơ HS.00.{n6}
Phòng Bảo vệ, {body} {place}, số đăng ký kinh doanh {n10}. {filler}
The Registrar shall review the revised course outline before the end of term.
Trường {unit} {verb} {thing} tại hội trường {place}.
""".strip().split("\n")

FILLERS = """
{opening} {unit} {verb} {thing}.
{opening} {unit} tiếp tục {verb} {thing} theo đúng trình tự pháp luật.
{opening} {unit} chịu trách nhiệm {verb} {n} hồ sơ thuộc hộp số {n}, trong đó {n} hồ sơ cần {verb} lại.
{opening} mức chi cho việc {verb} {thing} là {money} đồng, lấy từ nguồn thu học phí.
{opening} văn bản số {n}/CV-CĐMK-ĐT ngày {date} về việc {verb} {thing} vẫn còn hiệu lực.
{opening} sinh viên đăng ký học phần {course} tại cơ sở CS{d} phải nộp {thing}.
{opening} tỷ lệ {thing} đã {verb} là 82,3%, cao hơn năm 20{d}{d}-20{d}{d}.
{opening} {thing} được {verb} và {verb} theo mẫu đính kèm, còn {thing} do {unit} {verb}.
{opening} nếu {thing} chưa được {verb} thì {unit} không được phép {verb} {thing}.
{unit} phối hợp với các đơn vị để {verb} {thing} và gửi về bộ phận văn thư.
Văn bản số {n}/KH-ĐHĐH ngày {date} về việc {verb} {thing} vẫn còn hiệu lực.
""".strip().split("\n")

OPENINGS = "Trong học kỳ vừa qua,|Kể từ ngày ký,|Nhằm bảo đảm tiến độ,|Theo kế hoạch đã duyệt,|Sau khi rà soát hồ sơ,|Trước khi bàn giao tài liệu,|Ngoài các nội dung nêu trên,|Căn cứ biên bản cuộc họp,|Đối với sinh viên khóa mới,|Khi có yêu cầu bằng văn bản,|Trường hợp phát sinh vướng mắc,|Trên cơ sở đề nghị của các đơn vị,".split("|")
IDS = "CCCD|CCCD:|CCCD số|CMND số|CMND|CMND:|số căn cước|căn cước công dân số|Số định danh:|số định danh|hộ chiếu|hộ chiếu số|Hộ chiếu:|Passport No.|mã BHXH|sổ BHXH số|số sổ bảo hiểm xã hội|chứng minh nhân dân số|giấy CMND số".split("|")


def unaccented(text: str) -> str:
    marks = unicodedata.normalize("NFD", text.replace("Đ", "D").replace("đ", "d"))
    return "".join(c for c in marks if not unicodedata.combining(c))


class Filler:
    """Makes up what stands in the slots."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def digits(self, n: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(n))

    def place(self, most: int = 3) -> str:
        pool = PLACES + FAMILY + ["Tam"] if self.r.random() < 0.3 else PLACES
        return " ".join(self.r.sample(pool, self.r.randint(2, most)))

    def name(self) -> str:
        r = self.r
        if r.random() < 0.17:
            text = f"{r.choice(FIRST)} {(r.choice(SYLLABLES) + r.choice(SYLLABLES) + r.choice(['', r.choice(SYLLABLES)])).capitalize()}"
            return text.upper() if r.random() < 0.15 else text
        pool = GIVEN + MIDDLE + PLACES
        text = " ".join([r.choice(FAMILY), *(r.choice(MIDDLE if r.random() < 0.7 else pool) for _ in range(r.choice([0, 1, 1, 1, 2, 2]))), r.choice(GIVEN if r.random() < 0.7 else pool)])
        form = r.random()
        if form < 0.13:
            return text.upper()
        if form < 0.27:
            return unaccented(text)
        if form < 0.36:
            return text.lower()
        return unaccented(text).upper() if form < 0.38 else text

    def address(self) -> str:
        r = self.r
        number = r.choice([f"{r.randint(1, 400)}", f"{r.randint(1, 400)}{r.choice('ABC')}", f"số {r.randint(1, 400)}/{r.randint(1, 60)}", f"số {r.randint(1, 400)}", f"{r.randint(1, 99)}/{r.randint(1, 40)}", f"số nhà {r.randint(1, 90)}"])
        street, city = self.place(), self.place(2)
        form = r.random()
        if form < 0.22:
            return f"{number} đường {street}, phường {self.place()}, thành phố {city}"
        if form < 0.40:
            return f"{number} {street}, phường {self.place()}, Q. {r.randint(1, 12)}"
        if form < 0.58:
            return f"{number} {street}, P. {self.place()}, TP. {city}"
        if form < 0.72:
            return f"{r.choice(['ấp', 'thôn', 'xóm', 'bản', 'ấp'])} {r.choice([str(r.randint(1, 9)), self.place(2)])}, xã {self.place()}, huyện {city}"
        if form < 0.84:
            return f"tổ {r.randint(1, 30)}, {r.choice(['khu phố', 'khu phố', 'tổ dân phố'])} {r.randint(1, 12)}, phường {self.place()}, thành phố {city}, tỉnh {self.place(2)}"
        return unaccented(f"{r.randint(1, 400)} {street} Street, {self.place()} Ward, {city} City")

    def phone(self) -> str:
        r, d = self.r, self.digits
        head = r.choice("35789")
        zero = "O" if r.random() < 0.12 else "0"
        return r.choice([
            lambda: zero + head + d(8), lambda: f"{zero}{head}{d(2)} {d(3)} {d(3)}", lambda: f"{zero}{head}{d(2)}.{d(3)}.{d(3)}", lambda: f"{zero}{head}{d(1)}-{d(3)}-{d(4)}",
            lambda: f"+84 {head}{d(2)} {d(3)} {d(3)}", lambda: f"84{head}{d(8)}", lambda: f"(+84) {head}{d(1)}-{d(3)}-{d(4)}", lambda: f"({zero}2{d(2)}) {d(4)} {d(3)}", lambda: f"+84{head}{d(8)}", lambda: f"{zero}2{d(1)} {d(4)} {d(4)}",
        ])()

    def email(self) -> str:
        r = self.r
        words = unaccented(self.name()).lower().split()
        local = r.choice(["_".join(words), f"{words[0]}+hs{r.randint(1, 9)}", f"{words[-1]}{r.randint(1, 99)}", f"{words[-1]}.{words[0]}", f"{words[-1]}{words[0][0]}", "".join(w[0] for w in words) + words[-1]])
        at = r.choices(["@", "(at)", " @ ", " [at] ", " (a còng) "], [73, 7, 8, 5, 7])[0]
        host = unaccented("".join(r.sample(PLACES, 2))).lower() + r.choice([".example", ".edu.example", ".test", ".edu.vn", ".com", ".org"])
        if r.random() < 0.2:
            host = r.choice(["sv", "thu", "mail"]) + "." + host
        if r.random() < 0.08:
            host = host.replace(".", " .", 1)
        text = f"{local}{at}{host}"
        return text.upper() if r.random() < 0.06 else text

    def idno(self, kind: str) -> str:
        r, d = self.r, self.digits
        low = kind.lower()
        if "hộ chiếu" in low or "passport" in low:
            return r.choice("BCNKP") + d(7)
        if "bhxh" in low or "bảo hiểm" in low:
            return d(10)
        if "cmnd" in low or "chứng minh" in low:
            return r.choice([d(9), f"{d(3)} {d(3)} {d(3)}", d(9)])
        return r.choice(["0" + d(11), f"0{d(2)} {d(3)} {d(3)} {d(3)}", "0" + d(11)])

    def date(self) -> str:
        r = self.r
        return r.choice([f"{r.randint(1, 28)}/{r.randint(1, 12)}/20{self.digits(2)}", f"{r.randint(1, 28):02d}-{r.randint(1, 12):02d}-20{self.digits(2)}", f"{r.randint(1, 28)} tháng {r.randint(1, 12)} năm 20{self.digits(2)}", f"{r.randint(1, 28)}.{r.randint(1, 12)}.20{self.digits(2)}"])

    def plain(self, slot: str) -> str:
        r = self.r
        if slot[0] == "n" and slot[1:].isdigit():
            return self.digits(int(slot[1:]))
        made = {
            "title": lambda: r.choice(TITLES), "id": lambda: r.choice(IDS), "date": self.date, "n": lambda: str(r.randint(1, 999)), "d": lambda: str(r.randint(1, 9)), "post": lambda: r.choice(POSTS),
            "postcaps": lambda: r.choice(POSTS).upper(), "unit": lambda: r.choice(UNITS), "verb": lambda: r.choice(VERBS), "thing": lambda: r.choice(THINGS), "place": self.place, "body": lambda: r.choice(BODIES),
            "bodycaps": lambda: f"{r.choice(BODIES)} {self.place()}".upper(), "money": lambda: f"{r.randint(1, 999)}.{self.digits(3)}.000", "code7": lambda: r.choice(["XL", "YK", "ZN", "VD"]) + self.digits(7),
            "course": lambda: r.choice(["TIN", "KTE", "LUA", "ENG"]) + self.digits(3), "opening": lambda: r.choice(OPENINGS),
        }
        return made[slot]()


def _noise(r: random.Random, text: str) -> str:
    """Now and then a misread character."""
    out = []
    for char in text:
        x = r.random()
        if char.isalpha() and x < 0.006:
            out.append(r.choice(["?", {"h": "li", "n": "ri", "m": "rn", "u": "ii", "d": "cl", "i": "1", "o": "0", "g": "9"}.get(char, "?"), char + r.choice("|^~;'")]))
        else:
            out.append(char)
    return "".join(out)


def sentences(size: int = 1500, seed: int = 11) -> list[list[tuple[str, str]]]:
    """``size`` sentences, each a list of (text, label) parts in order; label ``""`` is outside."""
    fill = Filler(seed)
    r = fill.r

    def expand(pattern: str, parts: list[tuple[str, str]]) -> None:
        at, kind = 0, "CCCD"
        while at < len(pattern):
            char = pattern[at]
            if char in "{[":
                end = pattern.index("}" if char == "{" else "]", at)
                slot = pattern[at + 1 : end]
                at = end + 1
                if char == "[":
                    label = "idno" if slot == "pid" else slot
                    text = "0" + fill.digits(11) if slot == "pid" else fill.idno(kind) if slot == "idno" else getattr(fill, slot)()
                    parts.append((_noise(r, text) if slot in ("name", "address") else text, label))
                elif slot == "filler":
                    expand(r.choice(FILLERS), parts)
                else:
                    text = fill.plain(slot)
                    kind = text if slot == "id" else kind
                    parts.append((_noise(r, text), ""))
            else:
                end = min(e for e in (pattern.find("{", at), pattern.find("[", at), len(pattern)) if e >= 0)
                parts.append((_noise(r, pattern[at:end]), ""))
                at = end

    out = []
    for i in range(size):
        pattern = WITH[i // 3 % len(WITH)] if i % 3 < 2 and (i + i // 3) % 5 < 4 or i % 7 == 0 else WITHOUT[i % len(WITHOUT)]
        if r.random() < 0.7:
            pattern = r.choice(WITH) if r.random() < 0.68 else r.choice(WITHOUT)
        parts: list[tuple[str, str]] = []
        expand(pattern, parts)
        out.append(parts)
    return out
