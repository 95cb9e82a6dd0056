"""Small C# sources for tests."""

SHAPES = """using System;
using System.Text;
using Lib.Unused;
using Lib.Used;
// Foo and Foobar
namespace Shop.Core
{
    /// <summary> A shape. </summary>
    /// <param name="a">x</param>
    public interface IShape { double Area(); }

    public abstract class Base : IShape
    {
        public virtual double Area() { return 0; }
        protected abstract void Draw(int a, string b = "x");
    }

    public class Circle : Base
    {
        private double _r;
        public double R { get; set; }
        public Circle(double r) { _r = r; }
        public override double Area()
        {
            if (_r > 0 && R > 0) { return Scale(_r); }
            for (int i = 0; i < 3; i++) { Log("i"); }
            return R > 1 ? 2 : Scale(3);
        }
        double Scale(double x) { Helper h = new Helper(); return Log(x); }
        double Log(object x) { return Scale(1); }
        class Inner { void Deep() { while (true) { } } }
    }
}
"""
HELPER = "﻿namespace Lib.Used;\npublic static class Helper\n{\n    public static int Twice(this int x) => x * 2;\n}\n"
EDGE = ["", "class", "class A {", "}}}", "int x = 1;", "/* open", '"open', "namespace A; class B { void M( { } }", "@\"a\"\"b\" ? : ;", "\r\n#if X\n#endif"]
