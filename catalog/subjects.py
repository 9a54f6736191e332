"""The ``subjects`` view: a customer file with identifiers, derived from ``customer``.

The same SQL text runs on Spark and on DuckDB and gives the same rows, one per
customer.  Identifiers carry valid checksums; ``order_ref`` looks like an ID but
has a wrong check digit.  Some cells are null, blank, in Arabic digits, or
written with separators.
"""

from pyspark.sql import DataFrame

ARABIC = "translate({}, '0123456789', '٠١٢٣٤٥٦٧٨٩')"
_AR_FIRST = "محمد,أحمد,خالد,فهد,سعود,نورة,سارة,فاطمة,ريم,هند,لينا"
_AR_FAMILY = "القحطاني,العتيبي,الدوسري,الشمري,الغامدي,الزهراني,الحربي"
_EN_FIRST = "Mohammed,Ahmed,Khalid,Fahad,Saud,Noura,Sarah,Fatimah,Reem,Hind,Lina"
_EN_FAMILY = "Al-Qahtani,Al-Otaibi,Al-Dossari,Al-Shammari,Al-Ghamdi,Al-Zahrani,Al-Harbi"
_DISTRICT = "Al Rawdah,Al Mansak,Al Faisaliyah,Al Olaya,Al Naseem"
_AREA = "الروضة,المنسك,الفيصلية,العليا الشمالية,النسيم"
_JOB = "محاسب,مبرمج,معلم,مهندس,طبيب"

COLUMNS = ["customer_id", "customer_name_ar", "customer_name_en", "national_id", "mobile", "email", "iban", "address_ar",
           "age", "gender", "city", "district", "job", "salary", "birth_date", "monthly_spending", "customer_segment",
           "order_ref", "notes"]


def _pick(words: str, place: str) -> str:
    return f"split_part('{words}', ',', cast(({place}) % {len(words.split(','))} as int) + 1)"


def _luhn_sum(body: str) -> str:
    digit = "cast(substr({b}, {i}, 1) as int)"
    return " + ".join(
        f"cast(substr('0246813579', {digit.format(b=body, i=i)} + 1, 1) as int)" if i % 2 else digit.format(b=body, i=i)
        for i in range(1, 10))


def subjects_sql(customer: str = "customer") -> str:
    spaced_iban = "concat_ws(' ', " + ", ".join(f"substr(iban, {i}, 4)" for i in range(1, 24, 4)) + ")"
    return f"""
select c_custkey,
  concat('CUST-', cast(1000 + c_custkey as string)) as customer_id,
  concat({_pick(_AR_FIRST, 'c_custkey * 5')}, case when c_custkey % 4 = 0 then ' بن ' else ' ' end,
         case when c_custkey % 4 = 0 then concat({_pick(_AR_FIRST, 'c_custkey * 3 + 1')}, ' ') else '' end,
         {_pick(_AR_FAMILY, 'c_custkey * 2')}) as customer_name_ar,
  concat({_pick(_EN_FIRST, 'c_custkey * 5')}, ' ', {_pick(_EN_FAMILY, 'c_custkey * 2')}) as customer_name_en,
  case c_custkey % 17 when 3 then null when 5 then '' when 7 then '   '
       when 4 then {ARABIC.format('id')} else id end as national_id,
  case c_custkey % 6 when 0 then concat('05', m) when 1 then concat('+9665', m) when 2 then concat('009665', m)
       when 3 then concat('05', substr(m, 1, 1), ' ', substr(m, 2, 3), ' ', substr(m, 5, 4))
       when 4 then concat('05', substr(m, 1, 1), '-', substr(m, 2, 3), '-', substr(m, 5, 4))
       else {ARABIC.format("concat('05', m)")} end as mobile,
  case c_custkey % 17 when 3 then null else concat('user', cast(c_custkey as string), '@example.com') end as email,
  case when c_custkey % 2 = 0 then iban else {spaced_iban} end as iban,
  case when c_custkey % 7 = 0 then 'Building 12, King Road'
       when c_custkey % 5 = 0 then concat('14 Street, ', {_pick(_DISTRICT, 'c_custkey')}, ' District, Riyadh')
       else concat('حي ', {_pick(_AREA, 'c_custkey')}, '، شارع الملك فهد، ',
                   cast(1000 + c_custkey % 9000 as string)) end as address_ar,
  cast(18 + c_custkey % 50 as string) as age,
  case when c_custkey % 9 < 5 then 'Male' else 'Female' end as gender,
  case when c_custkey % 17 = 6 then null when c_custkey % 13 = 0 then 'الرياض' when c_custkey % 29 = 0 then 'London'
       else {_pick('Riyadh,Jeddah,Dammam,Al Kharj,Abha', 'c_nationkey')} end as city,
  {_pick(_DISTRICT, 'c_custkey * 3')} as district,
  case when c_custkey % 40 = 0 then 'قاض' else {_pick(_JOB, 'c_custkey * 7 % 31')} end as job,
  case when c_custkey % 23 = 0 then 'n/a' when c_custkey % 10 = 0 then concat(cast(3 + c_custkey % 17 as string), ',500')
       else cast(3000 + (c_custkey * 37 % 400) * 50 as string) end as salary,
  concat(cast(1950 + c_custkey * 7 % 55 as string), '-', lpad(cast(1 + c_custkey % 12 as string), 2, '0'), '-',
         lpad(cast(1 + c_custkey % 28 as string), 2, '0')) as birth_date,
  cast(1000 + c_custkey * 13 % 9000 as string) as monthly_spending,
  c_mktsegment as customer_segment,
  concat(b, cast((check_digit + 1) % 10 as string)) as order_ref,
  case c_custkey % 8
       when 0 then concat('رقم الهوية: ', id) when 1 then concat('call mobile 05', m) when 2 then 'VIP follow-up'
       when 3 then concat('reach 5', m, ' after six') when 4 then concat('IBAN ', iban, ' and mail user', cast(c_custkey as string), '@mail.example.org')
       when 5 then concat('ID ', {ARABIC.format('id')}, ', phone +966 5', m) when 6 then concat('write to 05', m, '@example.com') else null end as notes
from (select *, concat(b, cast(check_digit as string)) as id,
        concat('SA', lpad(cast(98 - r as string), 2, '0'), bban) as iban
      from (select *, (10 - ({_luhn_sum('b')}) % 10) % 10 as check_digit,
              cast(concat(cast(cast(substr(concat(bban, '281000'), 1, 13) as bigint) % 97 as string),
                          substr(concat(bban, '281000'), 14)) as bigint) % 97 as r
            from (select c_custkey, c_nationkey, c_mktsegment,
                    concat(case when c_custkey % 5 = 0 then '2' else '1' end,
                           lpad(cast((c_custkey * 7919 + 104729) % 100000000 as string), 8, '0')) as b,
                    lpad(cast((c_custkey * 1299709 + 15485863) % 100000000 as string), 8, '0') as m,
                    concat('80', lpad(cast((c_custkey * 32452843 + 49979687) % 1000000000 as string), 9, '0'),
                           lpad(cast((c_custkey * 86028121 + 179424673) % 1000000000 as string), 9, '0')) as bban
                  from {customer}) keys) checks) ids
"""


def subjects(customer: DataFrame) -> DataFrame:
    return customer.sparkSession.sql(subjects_sql("{customer}"), customer=customer)
