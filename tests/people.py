"""A clean 48-row customer file with known findings."""

AR_FIRST = ["محمد", "أحمد", "خالد", "فهد", "سعود", "نورة"]
AR_FAMILY = ["القحطاني", "العتيبي", "الدوسري", "الشمري", "الغامدي", "الزهراني", "الحربي"]
EN_FIRST = ["Mohammed", "Ahmed", "Khalid", "Fahad", "Saud", "Noura"]
EN_FAMILY = ["Al-Qahtani", "Al-Otaibi", "Al-Dossari", "Al-Shammari", "Al-Ghamdi", "Al-Zahrani", "Al-Harbi"]
CITIES = ["Jeddah", "Riyadh", "Dammam", "Al Kharj", "Abha"]
DISTRICTS = ["Al Rawdah", "Al Mansak", "Al Olaya"]
JOBS = ["محاسب", "مبرمج", "موظف حكومي", "معلم"]
COLUMNS = ["customer_id", "customer_name_ar", "customer_name_en", "national_id", "mobile", "email", "iban", "address_ar",
           "age", "gender", "city", "district", "job", "salary", "monthly_spending", "customer_segment", "order_ref",
           "notes"]


def luhn_ok(number: str) -> bool:
    odd, even = number[-1::-2], number[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def with_check_digit(body: str, right: bool = True) -> str:
    return next(body + d for d in "0123456789" if luhn_ok(body + d) is right)


def iban(bban: str) -> str:
    return f"SA{98 - int(bban + '281000') % 97:02d}{bban}"


def row(i: int) -> tuple:
    national_id = with_check_digit(f"{1 + (i % 5 == 0)}{(i * 7919 + 104729) % 10**8:08d}")
    mobile = f"05{(i * 1299709 + 15485863) % 10**8:08d}"
    compact = iban(f"80{(i * 32452843) % 10**9:09d}{(i * 86028121) % 10**9:09d}")
    spaced = " ".join(compact[k:k + 4] for k in range(0, 24, 4))
    email = f"user{i}@example.com"
    note = (f"رقم الهوية: {national_id}" if i < 12 else f"call mobile {mobile}" if i < 17 else
            f"email {email}" if i < 22 else "عميل منتظم" if i < 44 else "12 boxes")
    return (f"CUST-{1001 + i}", f"{AR_FIRST[i % 6]} {AR_FAMILY[i % 7]}", f"{EN_FIRST[i % 6]} {EN_FAMILY[i % 7]}",
            national_id, mobile, email, spaced if i % 2 else compact,
            f"حي الروضة، شارع الملك فهد، {1000 + i} {CITIES[i % 5]}", str(22 + i * 5 % 41), "Male" if i % 2 else "Female",
            CITIES[i % 5], DISTRICTS[i % 3], JOBS[i % 4], str(5000 + i * 350), str(2960 + i * 200),
            ["Standard", "Premium", "Basic"][i % 3], with_check_digit(f"{1 + i % 2}{i * 99991 % 10**8:08d}", False), note)


ROWS = [row(i) for i in range(48)]
