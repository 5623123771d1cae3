"""Timetable extraction on hand-written pages (FIXTURES.md F4)."""

from punctual.sources.timetable_pages import extract_timetable

PAGES = [
    (1, "table", "<html><h3>RAK To Dubai Union</h3><h5>Trip Details</h5><table>"
                 "<tr><th>No</th><th>Time</th><th>Dest</th></tr>"
                 "<tr><td>1</td><td>5.30</td><td>(Dubai)</td></tr>"
                 "<tr><td>2</td><td>07:15</td><td>Dubai Mall</td><td>extra</td></tr>"
                 "<tr><td>x3</td><td>08:00</td><td>Skip</td></tr>"
                 "<tr><td>4</td><td>09:00</td></tr></table><h6>Contact</h6><p>5 10:00 Ignored</p></html>"),
    (2, "text", "<html><h2>Sharjah to RAK</h2><h4>trip details</h4><p>7 6.45 Sharjah (Direct)</p>"
                "<p>not a trip</p><li>8 12:30 Al Nahda Station</li><p>9 13:00</p></html>"),
    (3, "two routes", "<html><h3>Campus Loop</h3><h5>Trip Details</h5><p>1 08:00 Main Gate</p>"
                      "<h3>RAK to Ajman</h3><h5>Trip Details</h5><p>2 09:00 Ajman</p></html>"),
    (4, "none", "<html><h1>News</h1><p>1 2 3 4</p><table><tr><td>1</td><td>2</td><td>3</td></tr></table></html>"),
]


def test_extract_hand_written_pages(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    got = sorted(tuple(r) for r in extract_timetable(pages).collect())
    assert got == sorted([
        ("RAK To Dubai Union", "From", 1, "5:30", "Dubai"),
        ("RAK To Dubai Union", "From", 2, "07:15", "Dubai Mall"),
        ("Sharjah to RAK", "To", 7, "6:45", "Sharjah Direct"),
        ("Sharjah to RAK", "To", 8, "12:30", "Al Nahda Station"),
        ("Campus Loop", "Unknown", 1, "08:00", "Main Gate"),
        ("RAK to Ajman", "From", 2, "09:00", "Ajman"),
    ])


ORDINARY = [
    # A <link> and a menu list before the section, an SVG path, a comment and a script that quote trips.
    (1, "u", "<html><head><link rel=x href=y></head><ul><li>Home</li></ul><svg><path d='M0'/></svg>"
             "<h3>RAK to Ajman</h3><h5>Trip Details</h5><!-- <p>1 01:00 No</p> --><script>'<p>2 02:00 No</p>'</script>"
             "<p>3 08:00 Ajman &amp; more</p></html>"),
    # Trips in other siblings: div, spans, ul, bare text.
    (2, "u", "<h2>Dibba to RAK</h2><h4>Trip <b>Details</b></h4><div>4 09:00 Dibba</div><span>5 10:00 North</span>"
             "<span>6 11:00 South</span><ul><li><b>7</b> 12:00 <i>East</i> Gate</li></ul>8 13:00 West<h4>Other</h4>9 14:00 No"),
    # A number beyond an int is no crash.
    (3, "u", "<h2>X to RAK</h2><h4>Trip Details</h4><p>99999999999999 15:00 Far</p>"),
    (4, "u", None), (5, "u", ""),
]


def test_ordinary_pages(spark):
    got = {tuple(r) for r in extract_timetable(spark.createDataFrame(ORDINARY, "page_id long, url string, html string")).collect()}
    assert got == {
        ("RAK to Ajman", "From", 3, "08:00", "Ajman & more"),
        ("Dibba to RAK", "To", 4, "09:00", "Dibba"), ("Dibba to RAK", "To", 5, "10:00", "North"),
        ("Dibba to RAK", "To", 6, "11:00", "South"), ("Dibba to RAK", "To", 7, "12:00", "East Gate"),
        ("Dibba to RAK", "To", 8, "13:00", "West"), ("X to RAK", "To", None, "15:00", "Far"),
    }


def test_extraction_moves_no_html(spark):
    pages = spark.createDataFrame(ORDINARY, "page_id long, url string, html string")
    plan = extract_timetable(pages)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Join" not in plan


def test_pages_that_would_overflow_a_recursive_match(spark):
    many = "<b>a</b> <i>b</i> " * 50_000
    pages = [(1, "u", f"<h3>A to RAK</h3><h5>Trip Details</h5><p>1 08:00 {many}</p><p>2 09:00 B</p>"),
             (2, "u", "<h3>B to RAK</h3><h5>Trip Details</h5><table>" + "<tr><td>3</td><td>10.00</td><td>C</td></tr>" * 20_000),
             (3, "u", "<h3>C to RAK</h3><h5>Trip Details</h5><p>4 11:00 D</p>" + "<!-- " * 50_000),
             (4, "u", "<h3>D to RAK</h3><h5>Trip Details</h5><p>5 12:00 E</p>" + "<h4><table" * 50_000),
             (5, "u", "<h3>E to RAK</h3><h5>Trip Details</h5><p>6 13:00 F</p>" + "<" * 300_000)]
    got = {(r.trip_no, r.departure_time, r.destination[:3]) for r in
           extract_timetable(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {(1, "08:00", "a b"), (2, "09:00", "B"), (3, "10:00", "C"), (4, "11:00", "D"), (5, "12:00", "E"), (6, "13:00", "F")}
