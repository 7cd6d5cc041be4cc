"""A small labelled table of texts: one label for each line that isn't blank, 1 if it holds markup, 2 if it is a list of links."""

EXAMPLES = [
    ("The meeting was moved to Tuesday.\nAll rooms are booked until noon.", "00"),
    ("Plain prose with a dash - and another one, nothing else.", "0"),
    ("Short", "0"),
    ("A line of words that goes on for quite some time because the author wanted to explain every detail of the matter at once.", "0"),
    ("- apples\n- pears\n- plums", "000"),
    ("1. first step\n2. second step\n3) third step", "000"),
    ("12\tMiller\tpaid\n13\tSmith\topen", "00"),
    ("It costs $12 now and $9.50 later.", "0"),
    ("Tickets were $5 and $7, or $10 for both.", "0"),
    ("The files are in C:\\data\\2020\\reports and D:\\old\\begin.", "0"),
    ("See /usr/local/share and /home/office/plans for more.", "0"),
    ("Use List<Integer> here and Map<Key, Value> there.", "0"),
    ("A Set<Table> or Optional<Link> comes back.", "0"),
    ("Mail to <office@firm.example> or <12@firm.example>.", "0"),
    ("Values between <3..7> were accepted.", "0"),
    ("Enter <your name> and <room> in the form.", "0"),
    ("The test held for p < 0.05 and n > 30 in both arms.", "0"),
    ("I <3 this :-) and so do 4 < 5 of us.", "0"),
    ("If a == b and c != d then stop.", "0"),
    ("Steps: in -> out -> done, 3 => 4.", "0"),
    ("We multiply 3 * 4 * 5 and not 2 * 6.", "0"),
    ("Set max_row_count and min_row_count to one.", "0"),
    ("The variables old_total and new_total differ.", "0"),
    ("Ticket #12 came after #11.", "0"),
    ("We write C# and F# in 3 of 9 teams.", "0"),
    ("R&D met Q&A; then sales joined.", "0"),
    ("Fill in {name} and {date} for each row.", "0"),
    ("As notes [1] and [2] say, and [17] repeats.", "0"),
    ("It took ~20 days and ~3 people.", "0"),
    ("Call (030) 555 - 12 / 13 & ask.", "0"),
    ("He said 'yes' and \"no\" at 5'10\".", "0"),
    ("100 % = all, 50 % = half | rest", "0"),
    ("Visit https://www.firm.example/plan for the plan.", "0"),
    ("Read https://www.firm.example/a and https://www.firm.example/b today.", "0"),
    ("Notes of the day\n\nTwo people came - one left.\n- bread\n- milk", "0000"),
    ("x", "0"),
    ("<p>Hello there, friends.</p>", "1"),
    ("The <b>second</b> of three rows", "1"),
    ("Line one<br>and line two<br/>end", "1"),
    ("Words before <!-- hidden --> and after", "1"),
    ('See <a href="https://firm.example">our page</a> for more.', "1"),
    ('A picture <img src="/p.png" alt="P"/> stands here', "1"),
    ("A rest of </div> is left", "1"),
    ("Total<sup>2</sup> of the year", "1"),
    ("Grown<ref name=Smith>12</ref> again", "1"),
    ("<ul><li>one</li><li>two</li></ul>", "1"),
    ('Words <font color="#ff0000">in red</font> here', "1"),
    ("Fish &amp; chips for all", "1"),
    ("The caf&eacute; opens at nine", "1"),
    ("A blank&nbsp;and a dash&#8211;here", "1"),
    ("An old&#x20;sign", "1"),
    ("An escaped &lt;p&gt;tag&lt;/p&gt; here", "1"),
    ("# Title of the page\n\nPlain words follow here.", "10"),
    ("Before it\n\n### Deeper title\n\nPlain words again.", "010"),
    ("Overview of plans\n=================\nPlain words.", "100"),
    ("Second part\n-----------\nPlain words.", "100"),
    ("A **very** clear rule", "1"),
    ("The *last* of them", "1"),
    ("We ***never*** do", "1"),
    ("An __odd__ word", "1"),
    ("An _odd_ word too", "1"),
    ("This ~~old~~ new rule", "1"),
    ("Read [the guide](https://firm.example/guide) first.", "1"),
    ("![Chart](img/chart.png) shows it", "1"),
    ("> Quoted words of a colleague\n\nAn answer.", "10"),
    ("- [ ] call the bank\n- [x] pay the bill\n- rest", "110"),
    ("| name | sum |\n|---|---|\n| Ann | 3 |", "111"),
    ("Plain.\n| a | b |\n|:--|--:|\n| c | d |\nPlain again.", "01110"),
    ("Run `make all` twice", "1"),
    ("```python\nprint(1)\n```", "101"),
    ("```\nls\n```\nPlain words.", "1010"),
    ("The {{Infobox|name=Ann}} goes here", "1"),
    ("Some {{note|x=1}} and words", "1"),
    ("See [[Main page]] and [[Help:Start|the start]].", "1"),
    ("A [[File:map.svg|thumb|left]] of it", "1"),
    ("An ''odd'' thing", "1"),
    ("A '''strong''' thing", "1"),
    ("== History ==\nPlain words.", "10"),
    ("=== Later years ===\nPlain words.", "10"),
    ('{| class="wikitable"\n! Name\n|-\n| Ann\n|}', "11111"),
    ("{panel:title=Hint}Do it{panel}", "1"),
    ("{code:java}run();{code}", "1"),
    ("||Name||Sum||\n|Ann|3|", "11"),
    ("h2. Plans\nPlain words.", "10"),
    ("bq. Words of a colleague", "1"),
    ("\\section{Start}\nPlain words.", "10"),
    ("As \\cite{smith} says", "1"),
    ("It was shown~\\cite{miller} there", "1"),
    ("A \\textbf{strong} word", "1"),
    ("An \\emph{odd} word", "1"),
    ("See \\ref{sec:one} and \\label{eq:two}", "1"),
    ("Half is \\frac{1}{2} of it", "1"),
    ("\\begin{itemize}\n\\item one\n\\item two\n\\end{itemize}", "1111"),
    ("We have $x^2 + y$ here", "1"),
    ("We have $\\alpha \\leq 3$ here", "1"),
    ("It is \\(a_1/b\\) then", "1"),
    ("\\[ s = \\sqrt{2} \\] holds", "1"),
    ("So $$E = mc^2$$ is known", "1"),
    ("It costs $3 and <b>more</b>", "1"),
    ("Set max_rows and **min_rows** now", "1"),
    ("In C:\\data the \\emph{old} one", "1"),
    ("p < 3 and &lt; 4", "1"),
    ("Use List<Integer> or <code>int</code>", "1"),
    ("Notes [1] and [[two]]", "1"),
    ("Fill {name} and {{name|x=2}}", "1"),
    ("3 * 4 and *five* times", "1"),
    ("~20 and ~~30~~ days", "1"),
    ("[Home](/) [News](/news) [Contact](/contact)\n[Products](/p) [Prices](/c)\n[Imprint](/i)", "222"),
    ("- [Start](/a)\n- [Plans](/b)\n- [Staff](/c)\n- [Help](/d)", "2222"),
    ("[[Main page]] | [[Help]] | [[Contents]]\n[[Recent changes]] | [[Upload]]", "22"),
    ('<li><a href="/a">Home</a></li>\n<li><a href="/b">Our rooms</a></li>\n<li><a href="/c">Prices</a></li>', "222"),
    ('<a href="/">Home</a> <a href="/x">Archive</a> <a href="/y">Log in</a>\n<a href="/z">Terms of use</a>', "22"),
    ("[Back](/back) [Next](/next) [Up](/up)\n[Print](/print)", "22"),
    ("[Home](/) [News](/news) [Contact](/contact)", "2"),
    ("[[Start]] [[Index]] [[Search]] [[About us]]", "2"),
    ("The plan is in [the guide](/guide), which everyone should read before the first day of the new year.", "1"),
    ("Ask [Ann](/ann) or [Ben](/ben) about the keys, and bring the old badge along when you come to the desk.", "1"),
    ("See [[Main page]] for all of the rules that hold in this house and for the names of those who wrote them.", "1"),
    ('The <a href="/plan">plan of the year</a> was sent to all teams, who have two weeks to answer in writing.', "1"),
    ("[The report](/report)", "1"),
    ("[[The minutes]]", "1"),
    ('<a href="/list">The list of names</a>', "1"),
    ("https://firm.example/a\nhttps://firm.example/b\nhttps://firm.example/c", "000"),
]
