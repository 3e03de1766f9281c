from docloom.llm import sentences as S

CASES = {
    "Buổi lễ diễn ra tại P. 472, Q. 7, TP. Vân Lĩnh, lúc 9.30 ngày 21.4.2021. Theo đó, tất cả có mặt.": 2,
    "Thiết bị gồm máy chiếu, loa, micro, v.v. Trên cơ sở đó, Khoa làm việc.": 2,
    "Danh mục gồm sổ gốc, bảng điểm... và các phụ lục. Việc này còn phải chờ... Văn bản số 3 có hiệu lực.": 3,
    "Điều 3. Nội dung này (xem Điều 5. Khoản 4, tr. 27). Kể từ ngày ký.": 2,
    "Nơi nhận:\n- Như Điều 3;\n- Lưu VT, ĐT.": 3,
    "Dòng một\ncòn tiếp ở đây.\n\nĐOẠN HAI\n\nhết": 3,
    'Bà hỏi: "Ai giữ chìa khóa? Tôi không." nhưng không ai trả lời. Hết.': 2,
    "«Làm đi. Làm ngay.» Phòng đã làm. «Xong.», ông nói.": 3,
    "Người ký là T. B. Hậu, Kế toán trưởng. Vì sao?! Không rõ.": 3,
    "Dr. Halvard met Prof. Greyfield at 9 a.m. on Jan. 5, 2019. It cost $6.50, i.e. less.": 2,
    "The list covers boxes, etc. The U.S. office agreed.": 2,
    "M. Dupont et Mme. Durand ont signé à 15 h. « Le dossier est complet. Merci. » Fin.": 3,
    "校长说：“已经批准。公布了！”学校审查。“保存。整理。”主任这样回答。平均分为4．3％。": 4,
    "学長は「承認した。公開する。」と述べた。大学は承認した…。次。": 3,
    '총장은 "검토한다. 없다."라고 말했다. 대학은 승인하였다(제6조. 별표 참조). 끝.': 3,
    "समिति ने भेजी है । विभाग ने रखी है॥ औसत अंक 7.6 रहा।": 3,
    "គណៈកម្មការបានផ្ញើ។ដៃគូ ៕សាលា 8.4 ភាគរយ។": 3,
    "قال د. ورداد: «اللجنة راجعت. لا تأخير!» هل الجامعة وافقت؟ نعم.": 3,
    "คณะกรรมการตรวจสอบ มหาวิทยาลัยประกาศจำนวน 84 ฉบับ ฝ่ายทะเบียนเมื่อปีพ.ศ. 2564 ตามระเบียบ": 3,
    "ผู้อำนวยการกล่าวว่า “ส่งคืน ตามระเบียบ” ในที่ประชุม คณะกรรมการอนุมัติ": 2,
    "该公司名为ABC Co. Ltd.，注册号No. 705。档案室……教务处。": 3,
    "1. J. K. Halvard wrote vol. 3, no.\n2. The audit.\n2. Second item": 3,
    "": 0, "   \n\n ": 0, "x": 1, '"mở mà không đóng. Câu hai.': 2, "a) một;\nb) hai": 2,
}


def test_counts():
    for text, n in CASES.items():
        made = S.units(text)
        assert len(made) == n, (text, [text[a:b] for a, b in made])
        assert all(text[a:b] == text[a:b].strip() and a < b for a, b in made)
        kept = "".join(text[a:b] for a, b in made)
        assert "".join(kept.split()) == "".join(text.split())


def test_operator(spark):
    rows = [(1, "Một. Hai.", "t"), (2, "Một. Hai.", "t"), (3, None, "t"), (4, "", "t"), (5, "câu này dài. " * 5000, "t"), (None, "x", "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string, t string")
    got = [(r.doc_id, r.start_pos, r.end_pos) for r in S.split(df).collect()]
    assert [g for g in got if g[0] == 1] == [(1, 0, 4), (1, 5, 9)] and len([g for g in got if g[0] == 2]) == 2
    assert {g[0] for g in got} == {1, 2, 5, None}
    assert [r.unit for r in S.texts(df).where("doc_id = 1").orderBy("unit_index").collect()] == ["Một.", "Hai."]
    assert S.split(df.limit(0)).count() == 0


def test_list_levels_joined_sentences_and_partners():
    cases = {
        "1. Mở đầu\n2. Kết luận\n3. Hết": 3, "a) một\nb) hai:\n- ba\n- bốn\nc) năm": 5, "I) một\nII) hai\nIII) ba": 3, "Số hồ sơ là\n2 tập. Hết": 2, "1) Một\n5) Năm": 1, "- một\n- hai": 2,
        "Kế hoạch được duyệt tại phòng.Theo đó, tất cả có mặt.": 2, "It was filed.The office agreed.": 2, "Xem www.songvang.example tại ThS.Nguyễn An.": 1, "Danh mục (a). Sau đó.": 2,
        "“ “ “ " * 200: 1, "(mở\n\nđóng). Hết.": 3,
    }
    for text, n in cases.items():
        made = S.units(text)
        assert len(made) == n, (text[:60], [text[a:b] for a, b in made])
